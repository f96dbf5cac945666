"""Slow single-query models that the distributed operators are compared with."""

import math
import re
import unicodedata

INTENTS = ["overview", "problem", "research", "solution", "architecture", "interaction",
           "technology", "form", "value", "comparison", "contribution"]
STOP = set("a an about and are can could do does for how i in is it me my of on please tell the this "
           "to us we what when where which who why with you your".split())


def fold(s):
    return unicodedata.normalize("NFKC", s).lower()


def han(c):
    return "一" <= c <= "鿿"


def terms(s):
    seen = []
    for token in re.findall(r"[一-鿿]+|[a-z0-9]+(?:['-][a-z0-9]+)*", fold(s)):
        parts = [token]
        if han(token[0]) and len(token) > 1:
            parts = [token[i:i + 2] for i in range(len(token) - 1)]
        seen += [p for p in parts if p not in seen]
    return seen


def phrase(s):
    return "".join(c for c in fold(s) if unicodedata.category(c)[0] in "LN")


def question(s):
    s = re.sub(r"([a-z0-9])([一-鿿])", r"\1 \2", fold(s))
    s = re.sub(r"([一-鿿])([a-z0-9])", r"\1 \2", s)
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in s).split()


def normalized(s):
    return " ".join(question(s))


class Corpus:
    """chunk: dict in the canonical chunk layout."""

    def __init__(self, chunks):
        self.chunks = chunks
        self.body = {c["id"]: set(terms(c["text"])) for c in chunks}
        self.df = {}
        for body in self.body.values():
            for t in body:
                self.df[t] = self.df.get(t, 0) + 1
        self.n = len(chunks)
        self.average = max(1, sum(max(1, len(b)) for b in self.body.values()) / self.n)

    def bm25(self, term, c):
        if term not in self.body[c["id"]]:
            return 0.0
        idf = math.log(1 + (self.n - self.df[term] + 0.5) / (self.df[term] + 0.5))
        norm = 0.25 + 0.75 * max(1, len(self.body[c["id"]])) / self.average
        return idf * 2.2 / (1 + 1.2 * norm)

    def lexical(self, query, limit=8, minimum=2.5, per=3):
        if not phrase(query):
            return []
        wanted = [t for t in terms(query) if t not in STOP]
        rows = []
        for c in self.chunks:
            fields = [(set(terms(c["title"])), 1.5), (set(terms(" ".join(c["aliases"]))), 1.75),
                      (set(terms(" ".join(c["tags"]))), 1.25), (set(terms(c["source_id"])), 1.0)]
            score = sum(self.bm25(t, c) + sum(w for f, w in fields if t in f) for t in wanted)
            score += 6 * (phrase(query) == phrase(c["title"]))
            score += 6 * (phrase(query) in [phrase(a) for a in c["aliases"]])
            score += 4 * (phrase(query) == phrase(c["source_id"]))
            score += 1 * (bool(wanted) and set(wanted) <= fields[1][0])
            if score > 0 and score >= minimum:
                rows.append((c["id"], c["source_id"], score))
        rows.sort(key=lambda r: (-round(r[2], 9), r[0]))
        out, used = [], {}
        for r in rows:
            if len(out) < limit and used.get(r[1], 0) < per:
                used[r[1]] = used.get(r[1], 0) + 1
                out.append(r)
        return out

    def route(self, query, aliases):
        q = normalized(query)
        occurs = lambda p: bool(p) and (p in q if any(han(c) for c in p) else f" {p} " in f" {q} ")
        claims = [c for c in self.chunks if c["knowledge_kind"] == "authored-claim" and c["project_id"]]
        catalog = list(dict.fromkeys(c["project_id"] for c in claims))
        phrases = set()
        for c in claims:
            for a in [*c["aliases"], c["title"], c["project_id"]]:
                p = normalized(a)
                if p == normalized(c["project_id"]) or (
                        len(p) >= 2 if any(han(x) for x in p) else " " in p):
                    phrases.add((c["project_id"], p))
        projects = {p for p, a in phrases if occurs(a)}
        exact = [c for c in claims if q in [normalized(x) for x in c["question_aliases"]]]
        projects |= {c["project_id"] for c in exact}
        names = {a for _, a in phrases}
        hits = [(i, normalized(a)) for i, group in aliases.items() for a in group
                if normalized(a) not in names and occurs(normalized(a))]
        intents = {i for i, p in hits
                   if not any(j != i and len(o) > len(p) and p in o for j, o in hits)}
        if not intents:
            intents = {i for c in exact for i in c["intents"]}
        if not projects and "comparison" in intents:
            projects = set(catalog)
        if not projects:
            intents &= {"contribution"}
        return [p for p in catalog if p in projects], [i for i in INTENTS if i in intents]

    def structured(self, query, aliases, limit=8, minimum=2.5, per=3):
        q = normalized(query)
        if not q:
            return []
        projects, intents = self.route(query, aliases)
        wanted = [t for t in terms(query) if t not in STOP]
        contribution = "contribution" in intents
        rows = []
        for c in self.chunks:
            claim = c["knowledge_kind"] == "authored-claim"
            owner = claim and c["provenance"] == "owner_statement"
            routed = bool(projects) and c["project_id"] in projects
            if projects and c["project_id"] is not None and not routed:
                continue
            if contribution:
                ok = (not claim and c["source_id"] in ("profile", "resume")) or (
                    owner and (not projects or routed))
            else:
                ok = not projects or routed
            if not ok:
                continue
            fields = [(set(terms(c["title"])), 1.5), (set(terms(" ".join(c["aliases"]))), 1.75),
                      (set(terms(" ".join(c["tags"]))), 1.25), (set(terms(c["source_id"])), 1.0),
                      (set(terms(" ".join(c["question_aliases"]))), 3.0)]
            lexical = [self.bm25(t, c) + sum(w for f, w in fields if t in f) for t in wanted]
            matching = sum(i in c["intents"] for i in intents) if claim else 0
            exact = q in [normalized(x) for x in c["question_aliases"]]
            if not (routed or any(x > 0 for x in lexical) or matching or exact):
                continue
            score = 20 * routed + sum(lexical) + 12 * claim + 8 * matching + 12 * exact
            score += {"high": 4, "medium": 0, "low": -8}[c["information_density"]]
            score += 8 * ("overview" in intents and c["page_role"] == "overview")
            score += 8 * ("architecture" in intents and c["page_role"] == "system-architecture")
            score -= 10 * (not contribution and claim and "contribution" in c["intents"])
            if score > 0 and score >= minimum:
                rows.append((c, score))
        rows.sort(key=lambda r: (-round(r[1], 9), r[0]["id"]))
        seen, unique = set(), []
        for c, score in rows:
            if c["knowledge_kind"] == "authored-claim":
                key = normalized(c["text"])
                if not key or key in seen:
                    continue
                seen.add(key)
            unique.append((c, score))
        return self.packet(unique, projects, intents, limit, per)

    @staticmethod
    def packet(rows, projects, intents, limit, per):
        out = []

        def intent(c):
            return c["intents"][0] if c["knowledge_kind"] == "authored-claim" and c["intents"] else None

        def page(c):
            p = c["evidence_pages"][0] if c["evidence_pages"] else c["page"]
            return None if p is None else (c["source_id"], p)

        def fits(c, sources, same_intent, new_page):
            chosen = [o[0] for o in out]
            near = [u for u in chosen if u["source_id"] == c["source_id"]]
            alike = [u for u in chosen if intent(c) is not None and intent(u) == intent(c)]
            seen = page(c) is not None and any(page(u) == page(c) for u in chosen)
            return len(near) < sources and len(alike) < same_intent and not (new_page and seen)

        overview_only = bool(projects) and set(intents) <= {"overview"}
        if overview_only:
            out += [r for r in rows if r[0]["knowledge_kind"] == "authored-claim" and r[0]["page_role"] == "overview"][:1]
        start = per if "comparison" not in intents else min(2, per)
        any_number = len(rows) + 1
        relaxing = [(start, 1, True), (start, 2, False), (per, 2, True), (per, 2, False), (per, any_number, True), (per, any_number, False)]
        while relaxing and len(out) < limit:
            rest = [r for r in rows if r not in out and fits(r[0], *relaxing[0])]
            if rest:
                out.append(rest[0])
            else:
                relaxing.pop(0)
        return [(c["id"], c["source_id"], score) for c, score in out[:limit]]
