"""Operators in column functions: quality rules, license signatures, url filters."""

import random
import re

from pyspark.sql import functions as F

from evidentia.llm import license_scan, quality_rules, url_filters
from tests.llm import naive


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _quality(df):
    m = [f"measures.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    rows = quality_rules.judge(df).select("text", *m, "failed_rules").collect()
    for r in rows:
        want = naive.quality(r[0])
        assert tuple(r[1:6]) == want[:5], r[0]
        assert bool({"n_words", "repeated_windows"} & set(r[6])) == want[5]
    return rows


def test_quality_counts_equal_plain_model(sample, odd_documents):
    assert len(_quality(sample[1])) == len(sample[0])
    assert len(_quality(odd_documents)) == odd_documents.count()


def test_quality_keeps_columns_and_empty_tables(odd_documents):
    out = quality_rules.judge(odd_documents)
    assert out.columns[:7] == odd_documents.columns
    assert quality_rules.judge(odd_documents.limit(0)).count() == 0
    assert quality_rules.passing(odd_documents).columns == odd_documents.columns
    passed = {r.doc_id for r in quality_rules.passing(odd_documents).collect()}
    failed = {r.doc_id for r in out.collect() if r.failed_rules and r.doc_id is not None}
    assert passed and not (passed & failed)


def test_quality_windows_are_counted_once(spark):
    words = "a b c d e f a b c d e g a b c d e".split()
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    assert quality_rules.measures(df).select("measures.n_repeat_words").first()[0] == naive.quality(" ".join(words))[4]


def test_license_base_equals_plain_model(sample, odd_documents):
    for df in (sample[1], odd_documents):
        for r in license_scan.scan(df.select("text")).collect():
            v = r.license
            assert (v.n_words, v.n_base, v.first_word, v.last_word, ",".join(v.base_labels)) == naive.license_base(r.text)
            assert set(v.base_labels) <= set(v.labels) and 0 <= v.score <= 1


def test_license_signatures_and_containment(spark):
    cases = {
        "This work is licensed under the GNU General Public License, version 3.": ["gpl-3.0"],
        "Licensed under CC BY-NC-SA 4.0.": ["cc-by-nc", "cc-by-nc-sa"],  # the base phrase stays, the longer rule wins else
        "SPDX-License-Identifier: BSD-3-Clause": ["bsd-3-clause"],
        "the mit and the apache are not named as deeds here": [],
        "Released under the MIT License.": ["mit"],
        "ich gehe mit der license": [],
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    for r in license_scan.scan(df).collect():
        assert r.license.labels == cases[r.text], r.text
    assert len(license_scan.signatures()) > 200


_OWN = "Copyright (c) 2001 Some Body. "
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so")
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_BSD = _OWN + ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
               "are met: 1. Redistributions of source code must retain the above copyright notice. 2. Redistributions in binary form must reproduce it "
               "in the documentation and/or other materials provided with the distribution. ")
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"'
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software "
        "Foundation{} version {} of the License, or (at your option) any later version.")
_CASES = {
    # one-word forms
    "licensed under the GPLv3": ["gpl-3.0"], "Released under GPLv2+.": ["gpl-2.0"], "available under the AGPLv3 license": ["agpl-3.0"],
    "covered by: License: LGPLv3": ["lgpl-3.0"], "distributed under LGPLv2.1": ["lgpl-2.1"], "provided under the LGPLv2": ["lgpl-2.1"],
    "License: GPL3": ["gpl-3.0"], "License: GPL2": ["gpl-2.0"], "license: Apache2": ["apache-2.0"], "the MPLv2 license": ["mpl-2.0"], "License EPLv2": ["epl-2.0"],
    "distributed under the GNU GPLv3": ["gpl-3.0"], "GPL-3.0 license": ["gpl-3.0"], "licensed under GPL v3": ["gpl-3.0"], "under GPL version 2 license": ["gpl-2.0"],
    "licensed under the 3-clause BSD license": ["bsd-3-clause"], "License: 2-clause BSD": ["bsd-2-clause"],
    "subject to the terms of the Mozilla Public License, v. 2.0": ["mpl-2.0"], "the MIT licence": ["mit"],
    # standard headers
    _GNU.format("GNU General Public License", "; either", "3"): ["gpl-3.0"], _GNU.format("GNU General Public License", "; either", "2"): ["gpl-2.0"],
    _GNU.format("GNU General Public Licence", ", Inc.,", "2"): ["gpl-2.0"],
    _GNU.format("GNU Lesser General Public License", "; either", "2.1"): ["lgpl-2.1"], _GNU.format("GNU Lesser General Public License", ", either", "3"): ["lgpl-3.0"],
    _GNU.format("GNU Library General Public License", "; either", "2"): ["lgpl-2.0"], _GNU.format("GNU Affero General Public License", ", either", "3"): ["agpl-3.0"],
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not': ["apache-2", "apache-2.0"],
    # names without a version
    "licensed under the GNU General Public License": ["gpl"], "distributed under the GPL": ["gpl"], "the LGPL license": ["lgpl"],
    "available under the GNU Affero General Public License.": ["agpl"], "under a BSD-style license": ["bsd"], "the Apache License": ["apache"],
    "under the Mozilla Public License": ["mpl"], "the Eclipse Public License": ["epl"], "a Creative Commons license": ["cc"],
    "the Artistic License": ["artistic"], "the SIL Open Font License": ["ofl-1.1"], "the European Union Public Licence": ["eupl"],
    "the GNU Free Documentation License": ["gfdl"], "the Open Software License": ["osl"], "the Boost Software License": ["bsl-1.0"],
    # bodies
    _OWN + _MIT + ", subject to the following conditions:": ["mit"], _MIT + '. THE SOFTWARE IS PROVIDED "AS IS"': ["mit-0"],
    _MIT.replace("deal in", "deal with"): ["ncsa"],
    _ISC + ", provided that the above copyright notice": ["isc"], _ISC + '. THE SOFTWARE IS PROVIDED "AS IS"': ["0bsd"],
    _BSD + _AS_IS: ["bsd", "bsd-2-clause"],
    _BSD + "3. Neither the name of the Some Body Company nor the names of its contributors may be used to endorse or promote products derived from it. "
    + _AS_IS: ["bsd", "bsd-3-clause"],
    "Apache License Version 2.0, January 2004": ["apache-2", "apache-2.0"],
    "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, "
    "royalty-free, irrevocable copyright license to": ["apache-2.0"],
    "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed.": ["artistic-2.0"],
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
    "covered by this license": ["bsl-1.0"],
    "The person who associated a work with this deed has dedicated the work to the public domain": ["cc0-1.0"],
    'The accompanying program is provided under the terms of this Eclipse Public License ("Agreement")': ["epl-2.0"],
    "GNU GENERAL PUBLIC LICENSE Version 2, June 1991": ["gpl-2.0"], "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": ["gpl-3.0"],
    "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007": ["agpl-3.0"], "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999": ["lgpl-2.1"],
    "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007": ["lgpl-3.0"], "Mozilla Public License Version 2.0 1. Definitions": ["mpl-2.0"],
    "This license governs use of the accompanying software. If you use the software, you accept this license.": ["ms-pl"],
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written "
    "agreement is hereby granted": ["postgresql"],
    "PSF hereby grants Licensee a nonexclusive, royalty-free, world-wide license": ["python-2.0"],
    "This is free and unencumbered software released into the public domain.": ["unlicense"], "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE": ["wtfpl"],
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
    "from the use of this software.": ["zlib"],
    # addresses
    "https://opensource.org/licenses/MIT": ["mit"], "https://spdx.org/licenses/BSD-3-Clause.html": ["bsd-3-clause"],
    "https://www.gnu.org/licenses/gpl-3.0.html": ["gpl-3.0"], "see http://www.gnu.org/licenses/old-licenses/gpl-2.0.txt": ["gpl-2.0"],
    "http://www.gnu.org/licenses/gpl.html": ["gpl"], "http://www.apache.org/licenses/LICENSE-2.0": ["apache-2.0"],
    "https://creativecommons.org/licenses/by/4.0/": ["cc-by"], "https://creativecommons.org/licenses/by-nc/4.0/": ["cc-by-nc"],
    "https://creativecommons.org/licenses/by-nc-nd/4.0/": ["cc-by-nc-nd"], "https://creativecommons.org/licenses/by-nc-sa/3.0/": ["cc-by-nc-sa"],
    "https://creativecommons.org/licenses/by-nd/4.0/": ["cc-by-nd"], "https://creativecommons.org/licenses/by-sa/4.0/": ["cc-by-sa"],
    "https://creativecommons.org/publicdomain/zero/1.0/": ["cc0-1.0"], "https://www.boost.org/LICENSE_1_0.txt": ["bsl-1.0"],
    "https://www.eclipse.org/legal/epl-v10.html": ["epl-1.0"], "https://www.eclipse.org/legal/epl-2.0/": ["epl-2.0"], "http://mozilla.org/MPL/2.0/.": ["mpl-2.0"],
    "https://www.mozilla.org/en-US/MPL/2.0/": ["mpl-2.0"], "http://scripts.sil.org/OFL": ["ofl-1.1"], "<https://unlicense.org>": ["unlicense"], "http://www.wtfpl.net/": ["wtfpl"],
    # not a license
    "the general public was under the impression that mpl and epl are games": [], "neither the name of the town nor the promise was kept": [],
}


def test_license_texts_headers_names_and_addresses(spark):
    df = spark.createDataFrame([(t,) for t in _CASES], "text string")
    got = {r.text: r.license for r in license_scan.scan(df).collect()}
    assert {t: v.labels for t, v in got.items()} == _CASES
    assert all((v.score > 0) == bool(v.labels) for v in got.values())


def test_license_bodies_have_their_own_sentence_and_gates():
    """A gate word that a signature does not hold would keep it closed."""
    for r in license_scan.signatures():
        literal = {a for w in r.words for a in w.removesuffix("?").split("|")}
        assert r.gates and set(r.gates) <= literal, r
    words = [" " + " ".join("".join(c.lower() if c.isalnum() else " " for c in t).split()) + " " for t in _CASES]
    for r in license_scan.signatures()[-len(license_scan.BODIES):]:
        sentences = [" " + "".join(f" {i}={w}" for i, w in enumerate(t.split())) + " " for t in words]
        assert any(re.search(r.regex(), t) for t in sentences), r


def test_license_plan_has_no_python_and_no_shuffle(sample):
    plan = _plan(license_scan.scan(sample[1])) + _plan(quality_rules.judge(sample[1]))
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def _judge_plainly(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = naive.lower(rest[:cut]), rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h + p), len(h), h + p, v)
            best = max(best, key) if best else key
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls_equal_plain_model(spark):
    rng = random.Random(5)
    part = lambda: rng.choice(["a", "b", "c.a", "org", "com"])
    rules = list({(".".join(part() for _ in range(rng.randint(1, 3))), "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 3)))):
                  rng.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [None, "", "no scheme", "http://", "http://A.ORG", "x://c.a.org/a?q#f", "http://org.//b", "http://a.org/ä\U0010ffffz"]
    urls += ["http://" + ".".join(part() for _ in range(rng.randint(1, 4))) + "/" + "".join(rng.choice("ab/?#") for _ in range(rng.randint(0, 5)))
             for _ in range(400)]
    frame = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls + urls[:9])], "page_id long, url string, rule string")
    out = url_filters.judge_urls(frame, spark.createDataFrame(rules, "host string, path string, verdict string"))
    rows = out.collect()
    assert len(rows) == len(urls) + 9
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == _judge_plainly(r.url, rules), r.url


def test_registered_rules_have_the_words_of_the_contract(spark):
    urls = {"http://a.example.org/en/12?q": ("example.org/en/1", "block"), "http://example.org/es/x": ("example.org/es/", "block"),
            "http://example.org/en/2": ("org/", "allow"), "http://a.com/fr/": ("com/fr/", "allow"), "http://a.com/de/1": ("com/de/", "block")}
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    rules = spark.createDataFrame(url_filters.RULES, "host string, path string, verdict string")
    assert {r.url: (r.rule, r.verdict) for r in url_filters.judge_urls(frame, rules).collect()} == urls


def test_urls_repeated_null_and_no_rules(spark):
    frame = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    kind = "host string, path string, verdict string"
    twice = spark.createDataFrame([("a.org", "/", "allow"), ("a.org", "/", "block"), (None, "/x", "block")], kind)
    assert url_filters.judge_urls(frame, twice).select("rule", "verdict").first() == ("a.org/", "block")
    assert url_filters.judge_urls(frame, twice.limit(0)).select("rule", "verdict").first() == (None, "allow")
    assert url_filters.judge_urls(frame.limit(0), twice).count() == 0
    plan = _plan(url_filters.judge_urls(frame.withColumn("n", F.lit(1)), twice))
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_helper_columns_leave_the_callers_alone(spark):
    names = ["__words", "__lines", "__grams", "__count", "__opened", "__result", "__measures", "__failed", "__ROW"]
    docs = spark.createDataFrame([(1, "under the mit license " + "the quick brown fox jumps over it " * 3, *range(9))],
                                 "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    judged = quality_rules.judge(docs).first().asDict()
    scanned = license_scan.scan(docs).first().asDict()
    kept = quality_rules.passing(docs, thresholds=[]).collect()
    for row in (judged, scanned, kept[0].asDict()):
        assert [row[n] for n in names] == list(range(9))
    assert scanned["license"].base_labels == ["mit"] and judged["measures"].n_words == 25 and len(kept) == 1
    assert license_scan.scan(docs.limit(0)).count() == 0
