"""License scans: ordered signature rules behind a keyword gate, without user functions.

A signature is a sequence of words; every rule becomes one regular expression over the words of a text,
each written with its position (``17=mit``), so a match carries its own word interval. A rule runs only
on texts that hold all its gate words. Detections are sorted by start, longer first, then by priority;
one that lies inside an earlier one is suppressed. Base phrases are rules that are never suppressed.

All of it is row-local: one pass over the text, no shuffle. Matching is linear in the text for each rule
whose gate opens, and the sweep over detections keeps only the largest end and the distinct labels.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows are scanned one
by one; a column with the name of the result struct is replaced, all others stay; an empty table gives an empty table.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import NON_WORD, fresh, let, query, table, text_or_empty


@dataclass(frozen=True)
class Signature:
    """Word patterns in order; a trailing ``?`` makes a word optional. All gate words must occur in the text."""

    label: str
    words: tuple[str, ...]
    gates: tuple[str, ...]
    priority: int
    score: float
    base: bool = False

    def regex(self) -> str:
        parts = []
        for w in self.words:
            optional, w = w.endswith("?"), w.removesuffix("?")
            parts.append(rf"(?: \d+=(?:{w}))" + ("?" if optional else ""))
        return "".join(parts) + "(?= )"


# Phrases that always count.
BASE = [
    Signature("mit", ("under", "the", "mit", "license"), ("mit", "license"), 100, 1.0, True),
    Signature("apache-2", ("apache", "license", "version", "2"), ("apache", "license"), 100, 1.0, True),
    Signature("cc-by-nc", ("cc", "by", "nc"), ("cc", "nc"), 100, 1.0, True),
]

# License names as word patterns, the longest form of a name first. Spaces separate words, so ``|`` joins
# alternatives of one word only; a form written as one word (gplv3) is a name of its own, with itself as its gate.
# A name without a version has a label of its own; where the version is given as well, the longer match contains it.
_FSF = "as published by the free software foundation inc? either?"
NAMES: dict[str, list[str]] = {
    "0bsd": ["0bsd", "bsd zero clause", "zero clause bsd"],
    "afl-3.0": ["afl 3 0?", "academic free license v?3? 0?", "academic free license version 3 0?"],
    "agpl": ["agpl", "gnu agpl", "gnu affero general public license", "affero gpl", "affero general public license"],
    "agpl-3.0": ["agpl version|v? 3 0?", "agplv3 0?", "agpl3", "gnu agpl version|v? 3 0?", "gnu agplv3 0?", "gnu affero general public license version|v? 3 0?",
                 f"gnu affero general public license {_FSF} version 3 0?", "affero gpl version|v? 3 0?", "affero general public license version|v? 3 0?"],
    "apache": ["apache license", "apache software license"],
    "apache-1.1": ["apache 1 1", "apache software? license version|v? 1 1"],
    "apache-2.0": ["apache 2 0?", "apache2", "apachev2", "apache software? license version|v? 2 0?", "apache software? license 2 0?"],
    "artistic": ["artistic license"],
    "artistic-2.0": ["artistic 2 0", "artistic license version|v? 2 0?"],
    "bsd": ["bsd", "bsd style", "berkeley software distribution"],
    "bsd-2-clause": ["bsd 2 clause", "2 clause bsd", "bsd2", "simplified bsd", "freebsd", "two clause bsd"],
    "bsd-3-clause": ["bsd 3 clause", "3 clause bsd", "bsd3", "new|modified|revised bsd", "three clause bsd"],
    "bsl-1.0": ["bsl 1 0", "boost software license version|v? 1 0", "boost software license", "boost 1 0"],
    "cc": ["creative commons"],
    "cc0-1.0": ["cc0 1? 0?", "creative commons zero|cc0", "public domain dedication cc0"],
    "cc-by": ["cc by", "creative commons attribution"],
    "cc-by-nc": ["cc by nc", "creative commons attribution non commercial|noncommercial", "creative commons attribution noncommercial"],
    "cc-by-nc-nd": ["cc by nc nd", "creative commons attribution noncommercial noderivatives|noderivs", "creative commons attribution non commercial no derivatives|derivs"],
    "cc-by-nc-sa": ["cc by nc sa", "creative commons attribution noncommercial sharealike", "creative commons attribution non commercial share alike"],
    "cc-by-nd": ["cc by nd", "creative commons attribution noderivatives|noderivs", "creative commons attribution no derivatives|derivs"],
    "cc-by-sa": ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"],
    "cddl-1.0": ["cddl 1? 0?", "common development and distribution license"],
    "epl": ["epl", "eclipse public license"],
    "epl-1.0": ["epl v?1 0", "epl v 1 0", "eplv1 0?", "eclipse public license v?1 0", "eclipse public license version|v 1 0"],
    "epl-2.0": ["epl v?2 0", "epl v 2 0", "eplv2 0?", "epl2", "eclipse public license v?2 0", "eclipse public license version|v 2 0"],
    "eupl": ["eupl", "european union public licence|license"],
    "eupl-1.2": ["eupl version|v? 1 2", "european union public licence|license version|v? 1 2"],
    "gfdl": ["gfdl", "gnu free documentation license"],
    "gfdl-1.3": ["gfdl version|v? 1 3", "gnu free documentation license version|v? 1 3"],
    "gpl": ["gpl", "gnu gpl", "gnu general public license", "general public license"],
    "gpl-2.0": ["gpl version|v? 2 0?", "gplv2 0?", "gpl2", "gnu gpl version|v? 2 0?", "gnu gplv2 0?", "gnu general public license version|v? 2 0?",
                f"gnu general public license {_FSF} version 2 0?", "general public license version|v? 2 0?"],
    "gpl-3.0": ["gpl version|v? 3 0?", "gplv3 0?", "gpl3", "gnu gpl version|v? 3 0?", "gnu gplv3 0?", "gnu general public license version|v? 3 0?",
                f"gnu general public license {_FSF} version 3 0?", "general public license version|v? 3 0?"],
    "isc": ["isc", "internet systems consortium"],
    "lgpl": ["lgpl", "gnu lgpl", "gnu lesser general public license", "lesser general public license"],
    "lgpl-2.0": ["lgpl version|v? 2 0", "gnu library general public license", "gnu library general public license version|v? 2 0?",
                 f"gnu library general public license {_FSF} version 2 0?"],
    "lgpl-2.1": ["lgpl version|v? 2 1?", "lgplv2 1?", "lgpl2 1?", "lgpl21", "gnu lgpl version|v? 2 1?", "gnu lgplv2 1?",
                 "gnu lesser general public license version|v? 2 1?", f"gnu lesser general public license {_FSF} version 2 1?",
                 "lesser general public license version|v? 2 1?"],
    "lgpl-3.0": ["lgpl version|v? 3 0?", "lgplv3 0?", "lgpl3", "gnu lgpl version|v? 3 0?", "gnu lgplv3 0?",
                 "gnu lesser general public license version|v? 3 0?", f"gnu lesser general public license {_FSF} version 3 0?",
                 "lesser general public license version|v? 3 0?"],
    "mit": ["mit", "expat", "x11"],
    "mit-0": ["mit 0", "mit no attribution"],
    "mpl": ["mpl", "mozilla public license"],
    "mpl-1.1": ["mpl version|v? 1 1", "mozilla public license version|v? 1 1"],
    "mpl-2.0": ["mpl version|v? 2 0?", "mplv2 0?", "mpl2", "mozilla public license version|v? 2 0?"],
    "ms-pl": ["ms pl", "microsoft public license"],
    "ncsa": ["ncsa", "university of illinois ncsa"],
    "odbl-1.0": ["odbl 1? 0?", "open database license"],
    "ofl-1.1": ["ofl 1 1", "sil open font license version? 1 1", "ofl", "sil open font license"],
    "osl": ["open software license"],
    "osl-3.0": ["osl 3 0", "open software license version|v? 3 0"],
    "postgresql": ["postgresql"],
    "python-2.0": ["psf 2?", "python software foundation license version? 2?"],
    "unlicense": ["unlicense"],
    "wtfpl": ["wtfpl"],
    "zlib": ["zlib", "zlib libpng"],
}

_HOLDER = r" \S+?" * 10
_GRANT = "permission is hereby granted free of charge to any person"
_DEAL = f"{_GRANT} obtaining a copy of this software and associated documentation files the software to deal"
_MIT = f"{_DEAL} in the software without restriction"
_MIT_RIGHTS = (f"{_MIT} including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"
               " copies of the software and to permit persons to whom the software is furnished to do so")
_ISC = "permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted"
# Sentences of license texts, standard headers and addresses. They count wherever they stand. (label, words, gate words)
BODIES: list[tuple[str, str, str]] = [
    ("0bsd", f"{_ISC} the software is provided as is", "permission fee granted"),
    ("agpl-3.0", "gnu affero general public license version 3 19 november 2007", "affero november"),
    ("apache-2.0", "apache license version 2 0 january 2004", "apache january"),
    ("apache-2.0", "apache org licenses license 2 0", "apache licenses"),
    ("apache-2.0", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive"
                   " no charge royalty free irrevocable copyright license", "contributor irrevocable royalty"),
    ("artistic-2.0", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed",
     "establishes package redistributed"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     "redistribution binary permitted"),
    ("bsd-2-clause", "in the documentation and or other materials provided with the distribution this software is provided by",
     "documentation materials distribution provided"),
    ("bsd-3-clause", f"neither the name|names of{_HOLDER} nor the names of its|their contributors may be used to endorse or promote products derived",
     "neither endorse promote"),
    ("bsl-1.0", f"{_GRANT} or organization obtaining a copy of the software and accompanying documentation covered by this license",
     "organization accompanying granted"),
    ("bsl-1.0", "boost org license 1 0", "boost org"),
    ("cc-by", "creativecommons org licenses by", "creativecommons"),
    ("cc-by-nc", "creativecommons org licenses by nc", "creativecommons"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", "creativecommons"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", "creativecommons"),
    ("cc-by-nd", "creativecommons org licenses by nd", "creativecommons"),
    ("cc-by-sa", "creativecommons org licenses by sa", "creativecommons"),
    ("cc0-1.0", "creativecommons org publicdomain zero", "creativecommons"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain", "deed dedicated"),
    ("epl-1.0", "eclipse org legal epl v10", "eclipse legal"),
    ("epl-2.0", "the accompanying program is provided under the terms of this eclipse public license epl? agreement", "eclipse accompanying"),
    ("gpl-2.0", "gnu general public license version 2 june 1991", "gnu june"),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007", "gnu june"),
    ("isc", f"{_ISC} provided that the above copyright notice", "permission fee granted"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999", "lesser february"),
    ("lgpl-3.0", "gnu lesser general public license version 3 29 june 2007", "lesser june"),
    ("mit", _MIT, "permission granted restriction"),
    ("mit-0", f"{_MIT_RIGHTS} the software is provided as is", "permission granted restriction sublicense"),
    ("mpl-2.0", "mozilla org mpl 2 0", "mozilla mpl"),
    ("mpl-2.0", "mozilla org en us mpl 2 0", "mozilla mpl"),
    ("mpl-2.0", "mozilla public license version 2 0 1 definitions", "mozilla definitions"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license", "governs accompanying accept"),
    ("ncsa", f"{_DEAL} with the software without restriction", "permission granted restriction"),
    ("ofl-1.1", "scripts sil org ofl", "sil ofl"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written"
                   " agreement is hereby granted", "permission written agreement"),
    ("python-2.0", "psf hereby grants licensee a nonexclusive royalty free world wide license", "psf licensee"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("unlicense", "unlicense org", "unlicense"),
    ("wtfpl", "do what the fuck you want to public license", "fuck"),
    ("wtfpl", "wtfpl net", "wtfpl"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"
             " arising from the use of this software", "implied authors liable"),
]

_USE = "licensed|released|distributed|available|published|licenced|covered|provided|shared"
_DEED = "license|licence|agreement"
_LICENSE = {"license": "license|licence", "licenses": "licenses|licences"}
# How a name is used. (words before, words after, gate word of the frame or "", priority, score)
FRAMES: list[tuple[tuple[str, ...], tuple[str, ...], str, int, float]] = [
    (("spdx", "license", "identifier"), (), "spdx", 90, 1.0),
    ((_USE, "under", "the?", "terms?", "of?", "the?", "a?"), (_DEED + "?",), "under", 80, 0.95),
    (("subject", "to", "the?", "terms?", "of?", "the?"), (_DEED + "?",), "subject", 70, 0.9),
    (("use", "of", "this", "[^ ]+", "is", "governed", "by", "the?"), (_DEED + "?",), "governed", 70, 0.9),
    (("this", "is", "free", "software", "under", "the?"), (_DEED + "?",), "software", 70, 0.9),
    (("license|licence", "is|type|name|identifier?", "the?"), (), "", 50, 0.7),
    (("the?",), (_DEED,), "", 40, 0.6),
    (("redistribute", "it", "and?", "or?", "modify", "it", "under", "the?", "terms?", "of?", "the?"), (_DEED + "?",), "redistribute", 80, 0.95),
]
# Addresses that end in the short form of a name.
ADDRESS = (("spdx|opensource|gnu|fsf|eclipse", "org", "licenses|license|legal", "old?", "licenses?"), (), "org", 60, 0.9)


def _words(name: str) -> tuple[str, ...]:
    return tuple(f"v?{w}" if w.removesuffix("?").isdigit() else _LICENSE.get(w, w) for w in name.split())


def signatures() -> list[Signature]:
    """Base phrases first, then every license name in every frame, then the sentences and addresses."""
    rules = list(BASE)
    for label, names in NAMES.items():
        for name in names:
            words = _words(name)
            # Every name has a word without alternatives, which serves as a gate.
            fixed = [w for w in words if not set(w) & set("?|")][:1]
            named = any(w.startswith(("license", "licence")) for w in words)
            for before, after, frame_gate, priority, score in FRAMES + [ADDRESS] * (not named):
                if named and after == (_DEED,):
                    after = ()
                gates = tuple(dict.fromkeys(g for g in [*fixed, frame_gate] if g))
                rules.append(Signature(label, before + words + after, gates, priority + len(words), score))
    rules += [Signature(label, _words(body), tuple(gates.split()), 95, 1.0) for label, body, gates in BODIES]
    return rules


def _rule_table(rules: list[Signature]) -> Column:
    return F.array(*[
        F.struct(F.lit(r.label).alias("label"), F.array(*[F.lit(g) for g in r.gates]).alias("gates"),
                 F.lit(r.regex()).alias("regex"), F.lit(-r.priority).alias("rank"), F.lit(r.score).alias("score"),
                 F.lit(r.base).alias("base"))
        for r in rules])


def _detections(numbered: Column, opened: Column) -> Column:
    """All matches of the opened rules, sorted by start, longer first, then priority."""
    def of_rule(r: Column) -> Column:
        def at(m: Column) -> Column:
            start = F.regexp_extract(m, r"^ (\d+)=", 1).cast("int")
            n = F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit("")))
            return F.struct(start.alias("start"), (-(start + n)).alias("minus_end"), r["rank"].alias("rank"),
                            r["label"].alias("label"), r["score"].alias("score"), r["base"].alias("base"))
        return F.transform(F.regexp_extract_all(numbered, r["regex"], F.lit(0)), at)
    return F.sort_array(F.flatten(F.transform(opened, of_rule)))


def _outcome(found: Column) -> Column:
    """Labels and score after suppression, and the base counts."""
    kind = "struct<end:int,labels:array<string>,score:double>"
    def step(a: Column, d: Column) -> Column:
        kept = d["base"] | (-d["minus_end"] > a["end"])
        return F.struct(
            F.greatest(a["end"], -d["minus_end"]).alias("end"),
            F.when(kept, F.array_union(a["labels"], F.array(d["label"]))).otherwise(a["labels"]).alias("labels"),
            F.when(kept, F.greatest(a["score"], d["score"])).otherwise(a["score"]).alias("score")).cast(kind)
    start = F.struct(F.lit(-1).alias("end"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score")).cast(kind)
    base = F.filter(found, lambda d: d["base"])
    starts = F.transform(base, lambda d: d["start"].cast("long"))
    return F.struct(
        F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_sort(F.array_distinct(F.transform(base, lambda d: d["label"]))).alias("base_labels"),
        F.aggregate(found, start, step, lambda a: F.struct(F.array_sort(a["labels"]).alias("labels"), a["score"].alias("score"))).alias("all"))


def scan(df: DataFrame, text: str = "text", rules: list[Signature] | None = None, out: str = "license") -> DataFrame:
    """Add a struct: n_words, n_base, first_word, last_word, base_labels, labels (arrays), score."""
    rules = signatures() if rules is None else rules
    body = text_or_empty(df, text)
    words, opened, result = fresh(df, "__words", "__opened", "__result")
    keywords = sorted({g for r in rules for g in r.gates})
    df = df.withColumn(words, F.array_remove(F.split(body, NON_WORD, -1), ""))
    present = F.array_intersect(F.transform(F.array(*map(F.lit, keywords)), lambda x: x),
                                F.split(F.lower(F.array_join(words, " ")), " ", -1))
    df = df.withColumn(opened, let(present, lambda have: F.when(
        F.size(have) > 0,
        F.filter(_rule_table(rules), lambda r: F.size(F.array_except(r["gates"], have)) == 0))))
    numbered = F.concat(F.array_join(F.transform(
        F.col(words),
        lambda w, i: F.concat(F.lit(" "), i.cast("string"), F.lit("="),
                              F.translate(w, string.ascii_uppercase, string.ascii_lowercase))), ""), F.lit(" "))
    found = let(numbered, lambda t: _detections(t, F.col(opened)))
    df = df.withColumn(result, F.when(F.size(opened) > 0, let(found, _outcome)))
    r, empty = (lambda k: F.col(f"{result}.{k}")), F.array().cast("array<string>")
    df = df.withColumn(out, F.struct(
        F.size(words).cast("long").alias("n_words"), F.coalesce(r("n_base"), F.lit(0).cast("long")).alias("n_base"),
        r("first_word").alias("first_word"), r("last_word").alias("last_word"),
        F.coalesce(r("base_labels"), empty).alias("base_labels"), F.coalesce(r("all.labels"), empty).alias("labels"),
        F.coalesce(r("all.score"), F.lit(0.0)).alias("score")))
    return df.drop(words, opened, result)


@query("op6_license_scan")
def op6_license_scan(spark, folder: str) -> DataFrame:
    """Scan every document with all signatures."""
    found = scan(table(spark, folder, "documents").select("doc_id", "text"))
    v = lambda k: F.col(f"license.{k}")
    return found.select(
        "doc_id", *[v(k).alias(k) for k in ("n_words", "n_base", "first_word", "last_word")],
        F.array_join(v("base_labels"), ",").alias("base_labels"), F.array_join(v("labels"), ",").alias("labels"),
        v("score").alias("score"))
