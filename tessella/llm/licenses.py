"""License scans: ordered signature rules with a keyword gate, in DataFrame operations only.

A rule is a regular expression over a text's words joined by single spaces, with a label, a
priority and a confidence, and the words that it can't match without. Words are taken from every
text once; only documents that hold the first such word of a rule (or of a base phrase) keep them,
and only rules all of whose words a document holds are tried on it. Of a document's detections, one
that lies inside another of the same or a higher priority is suppressed (of equal places, the
higher priority, then the earlier rule, stays); the rest give the labels.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.contamination import lower_ascii, words_of
from tessella.llm.shared import written

#: Phrases that the contract fixes: every place counts (fixed values).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Sentences of license texts and file headers: words needed, expression, label, priority, confidence.
SIGNATURES: list[tuple[str, str, str, int, float]] = [
    # Apache
    ("apache compliance", r"licensed under the apache license version 2 0 (?:the license )?you may not use this file except in compliance with the license", "apache-2.0", 4, 1.0),
    ("applicable basis", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2.0", 2, 0.9),
    ("apache licenses", r"www apache org licenses license 2 0", "apache-2.0", 2, 0.95),
    ("asf contributor", r"licensed to the apache software foundation asf under one or more contributor license agreements", "apache-2.0", 3, 0.99),
    ("apache includes", r"this product includes software developed by the apache software foundation", "apache-1.1", 2, 0.9),
    ("contributor perpetual", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable", "apache-2.0", 2, 0.85),
    # GNU family
    ("redistribute license", r"(?:this program|it) is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", 2, 0.97),
    ("redistribute lesser", r"is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl", 2, 0.97),
    ("redistribute library", r"is free software you can redistribute it and or modify it under the terms of the gnu library general public license", "lgpl", 2, 0.97),
    ("redistribute affero", r"is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", "agpl", 2, 0.97),
    ("merchantability hope", r"is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "gpl", 1, 0.8),
    ("received gnu", r"you should have received a copy of the gnu general public license", "gpl", 2, 0.95),
    ("received lesser", r"you should have received a copy of the gnu lesser general public license", "lgpl", 2, 0.95),
    ("received affero", r"you should have received a copy of the gnu affero general public license", "agpl", 2, 0.95),
    ("freedom designed", r"the licenses for most software (?:and other practical works )?are designed to take away your freedom", "gpl", 2, 0.95),
    ("copyleft gnu", r"the gnu general public license is a free copyleft license for software and other kinds of works", "gpl-3.0", 3, 0.99),
    ("copyleft affero", r"the gnu affero general public license is a free copyleft license for software and other kinds of works", "agpl-3.0", 3, 0.99),
    ("verbatim permitted", r"everyone is permitted to copy and distribute verbatim copies of this license document", "gnu", 1, 0.8),
    ("documentation gnu", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gfdl", 2, 0.99),
    ("exception modules", r"as a special exception the copyright holders of this library give you permission to link this library with independent modules", "classpath-exception", 3, 0.97),
    # MIT, X11, ISC and kin
    ("hereby charge", r"permission is hereby granted free of charge to any person obtaining a copy", "mit", 2, 0.95),
    ("sublicense restriction", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell", "mit", 2, 0.95),
    ("sublicense restriction", r"to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell", "ncsa", 2, 0.95),
    ("substantial notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit", 2, 0.95),
    ("noninfringement provided", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "mit", 2, 0.85),
    ("tort holders", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise", "mit", 1, 0.75),
    ("consortium advertising", r"the name of the x consortium shall not be used in advertising", "x11", 3, 0.97),
    ("fee purpose", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", 2, 0.95),
    ("fee purpose", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that", "isc", 2, 0.9),
    ("disclaims author", r"the author disclaims all warranties with regard to this software", "isc", 1, 0.8),
    ("fee agreement", r"for any purpose without fee and without a written agreement is hereby granted", "postgresql", 3, 0.97),
    ("fee documentation", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", "hpnd", 3, 0.95),
    ("evil good", r"the software shall be used for good not evil", "json", 3, 0.99),
    # BSD
    ("redistribution binary", r"redistribution and use in source and binary forms with or without modification are permitted", "bsd", 2, 0.95),
    ("redistributions retain", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd", 2, 0.95),
    ("redistributions reproduce", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "bsd", 2, 0.95),
    ("advertising acknowledgement", r"all advertising materials mentioning features or use of this software must display the following acknowledgement", "bsd-4-clause", 3, 0.95),
    ("contributors neither", r"neither the name of (?:\S+ ){1,8}nor the names of its contributors", "bsd-3-clause", 3, 0.95),
    ("endorse author", r"the name of the author may not be used to endorse or promote products derived from this software", "bsd-3-clause", 3, 0.9),
    ("contributors warranties", r"this software is provided by the copyright holders and contributors as is and any express or implied warranties", "bsd", 1, 0.85),
    ("views conclusions", r"the views and conclusions contained in the software and documentation are those of the authors", "bsd-2-clause", 3, 0.9),
    # zlib, Boost, OpenSSL, PHP
    ("arising authors", r"in no event will the authors be held liable for any damages arising from the use of this software", "zlib", 2, 0.9),
    ("misrepresented origin", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", "zlib", 2, 0.97),
    ("altered plainly", r"altered source versions must be plainly marked as such", "zlib", 2, 0.95),
    ("png supplied", r"the png reference library is supplied as is", "libpng", 2, 0.95),
    ("organization hereby", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "bsl-1.0", 3, 0.97),
    ("openssl toolkit", r"software developed by the openssl project for use in the openssl toolkit", "openssl", 2, 0.95),
    ("cryptographic eric", r"this product includes cryptographic software written by eric young", "ssleay", 2, 0.95),
    ("php freely", r"this product includes php software freely available from", "php", 2, 0.95),
    # Mozilla, Eclipse, CDDL and kin
    ("mozilla subject", r"this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0", 4, 1.0),
    ("mpl obtain", r"if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-2.0", 3, 0.97),
    ("mozilla contents", r"the contents of this file are subject to the mozilla public license version 1 1", "mpl-1.1", 4, 0.99),
    ("mozilla incompatible", r"incompatible with secondary licenses as defined by the mozilla public license", "mpl-2.0", 2, 0.9),
    ("eclipse accompanying", r"the accompanying materials are made available under the terms of the eclipse public license", "epl", 2, 0.97),
    ("common accompanying", r"the accompanying materials are made available under the terms of the common public license", "cpl", 2, 0.97),
    ("development contents", r"the contents of this file are subject to the terms of the common development and distribution license", "cddl", 2, 0.97),
    ("psf licensee", r"psf hereby grants licensee a nonexclusive royalty free world wide license", "psf", 2, 0.95),
    ("perl terms", r"under the same terms as perl itself", "perl", 2, 0.9),
    ("intent package", r"the intent of this document is to state the conditions under which a package may be copied", "artistic-1.0", 2, 0.95),
    ("establishes package", r"this license establishes the terms under which a given free software package may be copied", "artistic-2.0", 2, 0.95),
    ("notice w3c", r"w3c software (?:and document )?notice and license(?: by obtaining using and or copying this work you the licensee agree)?", "w3c", 2, 0.9),
    ("cecill french", r"governed by the cecill license under french law", "cecill", 2, 0.95),
    ("eupl licensed", r"licensed under the eupl", "eupl", 2, 0.9),
    ("accept software", r"if you use the software you accept this license if you do not accept the license do not use the software", "ms-pl", 2, 0.85),
    # Public domain
    ("compile anyone", r"anyone is free to copy modify publish use compile sell or distribute this software", "unlicense", 2, 0.97),
    ("jurisdictions domain", r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain", "unlicense", 2, 0.97),
    ("unencumbered domain", r"free and unencumbered software released into the public domain", "unlicense", 2, 0.98),
    ("deed domain", r"the person who associated a work with this deed has dedicated the work to the public domain", "cc0-1.0", 2, 0.97),
    ("waived neighboring", r"waived all copyright and related or neighboring rights", "cc0-1.0", 2, 0.95),
    # Creative Commons deeds
    ("creative commons work", r"this work is licensed under a creative commons", "cc", 1, 0.9),
    ("redistribute medium", r"copy and redistribute the material in any medium or format", "cc-by", 2, 0.85),
    ("credit indicate", r"you must give appropriate credit provide a link to the license and indicate if changes were made", "cc-by", 2, 0.9),
    ("remix contributions", r"if you remix transform or build upon the material you must distribute your contributions under the same license as the original", "cc-by-sa", 3, 0.95),
    ("material commercial", r"you may not use the material for commercial purposes", "cc-by-nc", 2, 0.9),
    ("remix modified", r"if you remix transform or build upon the material you may not distribute the modified material", "cc-by-nd", 3, 0.95),
    # Fonts, data, source-available and model licenses
    ("font sil", r"this font software is licensed under the sil open font license", "ofl", 2, 0.97),
    ("font typefaces", r"no copy of one or more of the font software typefaces may be sold by itself", "ofl", 2, 0.95),
    ("database open", r"this \S+ (?:database )?is made available under the open database license", "odbl", 2, 0.95),
    ("hosted managed", r"you may not provide the software to third parties as a hosted or managed service", "elastic-2.0", 3, 0.97),
    ("functionality parties", r"if you make the functionality of the program or a modified version available to third parties as a service", "sspl-1", 3, 0.97),
    ("licensor production", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", "busl-1.1", 3, 0.97),
    ("clause commons", r"commons clause license condition", "commons-clause", 2, 0.95),
    ("polyform", r"polyform (?:noncommercial|shield|small business|internal use|strict) license", "polyform", 2, 0.95),
    ("responsible ai", r"open (?:and )?responsible ai license", "openrail", 2, 0.9),
    ("llama community", r"llama (?:2|3|3 1|3 2|3 3|4) community license agreement", "llama", 2, 0.95),
    # Others
    ("fuck license", r"do what the fuck you want to public license", "wtfpl", 2, 0.99),
    ("beer stuff", r"you think this stuff is worth it you can buy me a beer in return", "beerware", 2, 0.95),
    ("unauthorized prohibited", r"unauthorized copying of this file via any medium is strictly prohibited", "proprietary", 2, 0.9),
    ("confidential proprietary", r"this software is the confidential and proprietary information of", "proprietary", 2, 0.9),
    ("reserved rights", r"all rights reserved", "proprietary", 0, 0.4),
]


def rules() -> list[tuple[int, str, str, str, int, float]]:
    """(order, words needed, expression, label, priority, confidence), most specific families first."""
    out: list[tuple[str, str, str, int, float]] = []
    spdx = r"spdx license identifier "
    # GNU family: names, versions and grants.
    gnu = [("affero general public", "agpl", "agpl"), ("lesser general public", "lgpl", "lgpl"), ("library general public", "lgpl", "lgpl"), ("general public", "gpl", "gpl"), ("free documentation", "gfdl", "gfdl")]
    versions = {"agpl": ["1", "3"], "lgpl": ["2", "2 1", "3"], "gpl": ["1", "2", "3"], "gfdl": ["1 1", "1 2", "1 3"]}
    for name, short, label in gnu:
        for v in versions[short]:
            tag = f"{label}-{v.replace(' ', '.')}"
            needs = "license general" if label == "gpl" else f"{name.split()[0 if 'general' in name else 1]} license"
            full = rf"(?:gnu )?{name} license (?:as published by the free software foundation )?(?:either )?(?:version |v ?)?{v}(?: 0)?"
            out += [
                (needs, rf"{full} or (?:(?:at your option )?any later version|later)", f"{tag}-or-later", 3, 0.99),
                (needs, rf"{full} only", f"{tag}-only", 3, 0.99),
                (needs, full, tag, 2, 0.95),
            ]
            # Short names with their version apart or in one word: "gpl v3", "gplv3", "gpl3".
            for lead, start in ((short, rf"{short} (?:version |v ?)?"), (f"{short}v{v[0]}", f"{short}v"), (f"{short}{v[0]}", short)):
                out += [
                    (lead, rf"{start}{v}(?: 0)? or later", f"{tag}-or-later", 3, 0.95),
                    (lead, rf"{start}{v}(?: 0)? only", f"{tag}-only", 3, 0.95),
                    (lead, rf"{start}{v}(?: 0)?", tag, 2, 0.9),
                ]
        out.append((needs, rf"gnu {name} license", label, 1, 0.8))
    # Creative Commons: every combination of elements and version.
    elements = ["by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"]
    words = {"by": "attribution", "sa": "share ?alike", "nd": "no ?derivatives", "nc": "non ?commercial"}
    for e in elements:
        long = " ".join(words[x] for x in e.split())
        label = "cc-" + e.replace(" ", "-")
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            tag = f"{label}-{v.replace(' ', '.')}"
            out += [
                ("cc", rf"cc {e} {v}", tag, 3, 0.97),
                ("commons creative", rf"creative commons {long} {v}", tag, 3, 0.99),
                ("creativecommons", rf"creativecommons org licenses {e} {v}", tag, 3, 0.99),
            ]
        out += [("cc", rf"cc {e}", label, 2, 0.75), ("commons creative", rf"creative commons {long}", label, 2, 0.85)]
    out += [
        ("cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0-1.0", 2, 0.95),
        ("commons creative", r"creative commons (?:zero|0)(?: v?1 0)?", "cc0-1.0", 2, 0.95),
        ("commons creative", r"creative commons(?: license)?", "cc", 1, 0.6),
        ("publicdomain", r"creativecommons org publicdomain zero 1 0", "cc0-1.0", 3, 0.99),
    ]
    # Other families: name, versions, label.
    others = [
        ("apache license", r"apache(?: software)? license", "apache", ["1 0", "1 1", "2 0"]),
        ("mozilla", r"mozilla public license", "mpl", ["1 0", "1 1", "2 0"]),
        ("eclipse license", r"eclipse public license", "epl", ["1 0", "2 0"]),
        ("development distribution", r"common development and distribution license", "cddl", ["1 0", "1 1"]),
        ("cddl", r"cddl", "cddl", ["1 0", "1 1"]),
        ("artistic license", r"artistic license", "artistic", ["1 0", "2 0"]),
        ("academic license", r"academic free license", "afl", ["1 1", "2 0", "2 1", "3 0"]),
        ("european union", r"european union public licen[cs]e", "eupl", ["1 0", "1 1", "1 2"]),
        ("boost license", r"boost software license", "bsl", ["1 0"]),
        ("license open software", r"open software license", "osl", ["1 0", "2 0", "2 1", "3 0"]),
        ("python license", r"python software foundation license", "psf", ["2 0"]),
        ("zope", r"zope public license", "zpl", ["1 1", "2 0", "2 1"]),
        ("cecill", r"cecill(?: free software license agreement)?", "cecill", ["1 0", "1 1", "2 0", "2 1"]),
        ("font license", r"(?:sil )?open font license", "ofl", ["1 0", "1 1"]),
        ("database license", r"open database license", "odbl", ["1 0"]),
        ("license common public", r"common public license", "cpl", ["1 0"]),
        ("microsoft license", r"microsoft public license", "ms-pl", []),
        ("microsoft license", r"microsoft reciprocal license", "ms-rl", []),
        ("mulan", r"mulan permissive software license", "mulanpsl", ["1", "2"]),
        ("license business source", r"business source license", "busl", ["1 1"]),
        ("license server side", r"server side public license", "sspl", ["1"]),
        ("elastic license", r"elastic license", "elastic", ["2 0"]),
    ]
    for keyword, name, label, known in others:
        for v in known:
            tag = f"{label}-{v.replace(' ', '.')}"
            out += [(keyword, rf"{name} (?:version |v ?)?{v}", tag, 3, 0.97), (keyword, rf"licensed under (?:the |an )?{name} (?:version |v ?)?{v}", tag, 3, 0.99)]
        out += [(keyword, name, label, 1, 0.8), (keyword, rf"(?:licensed|released|distributed|available) under (?:the |an )?{name}", label, 2, 0.9)]
    # Identifier lines.
    ids = ["mit", "isc", "zlib", "unlicense", "wtfpl", "0bsd", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "apache 1 1", "apache 2 0", "mpl 1 1", "mpl 2 0", "epl 1 0", "epl 2 0", "bsl 1 0", "cc0 1 0", "cc by 4 0", "cc by sa 4 0", "ofl 1 1", "postgresql", "ncsa", "unicode 3 0"]
    ids += [f"{s} {v} 0 {g}" for s, v, g in product(("gpl", "lgpl", "agpl"), ("2", "3"), ("only", "or later"))]
    out += [("spdx", spdx + i, i.replace(" ", "-"), 4, 1.0) for i in ids]
    # Names without versions.
    out += [
        ("license mit", r"(?:the )?mit license", "mit", 1, 0.9),
        ("license mit", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?mit license", "mit", 2, 0.97),
        ("licensed mit", r"mit licensed", "mit", 1, 0.7),
        ("bsd clause", r"bsd (?:2|two) clause(?: license)?", "bsd-2-clause", 2, 0.95),
        ("bsd clause", r"bsd (?:3|three) clause(?: license)?", "bsd-3-clause", 2, 0.95),
        ("bsd clause", r"bsd (?:4|four) clause(?: license)?", "bsd-4-clause", 2, 0.95),
        ("bsd license", r"(?:new |modified |simplified )?bsd license", "bsd", 1, 0.85),
        ("isc license", r"isc license", "isc", 1, 0.9),
        ("zlib license", r"zlib(?: libpng)? license", "zlib", 1, 0.9),
        ("unlicense", r"(?:the )?unlicense", "unlicense", 1, 0.85),
        ("domain public", r"(?:released|dedicated|placed) (?:in)?to the public domain", "public-domain", 1, 0.8),
        ("wtfpl", r"wtfpl", "wtfpl", 1, 0.9),
        ("postgresql", r"postgresql licen[cs]e", "postgresql", 1, 0.9),
        ("ncsa license", r"(?:university of illinois )?ncsa open source license", "ncsa", 1, 0.9),
        ("beerware license", r"beerware license", "beerware", 1, 0.9),
    ]
    out += SIGNATURES
    return [(i, *rule) for i, rule in enumerate(out)]


def _held(words: Column, needed: list[str]) -> Column:
    """Which of the needed words are among ``words``."""
    return F.array_intersect(words, F.array(*(F.lit(w) for w in needed)))


def scan(docs: DataFrame) -> DataFrame:
    """Base phrases and rule detections of every document.

    ``docs(doc_id, text)``; other columns are ignored. Returns per row ``doc_id, n_words, n_base,
    first_word, last_word, base_labels, labels, score``: places of the base phrases, their
    smallest and largest start in words, the base labels, those and the rules' labels, and the
    highest confidence of a kept detection. Null and empty texts have no words, empty labels and
    score 0. Rows may repeat and ids may be null: each row is scanned by itself. An empty table
    gives an empty one.

    One pass over the texts writes a numbered row a document, with its words only where a rule or
    phrase could match; all else reads those rows, and only detections and counts are shuffled.
    """
    spark = docs.sparkSession
    table = [(i, k.split(" ")[0], k.split(" ")[1:], *rest) for i, k, *rest in rules()]
    leads = sorted({r[1] for r in table})
    needed = sorted({*leads, *(w for r in table for w in r[2]), *(w for p in BASE for w in p.split(" "))})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(lower_ascii(F.col("text").cast("string"))).alias("w"))
    rows = rows.select("doc_id", "w", _held("w", needed).alias("held"))
    phrase = [F.forall(F.array(*(F.lit(w) for w in p.split(" "))), lambda w: F.array_contains(F.col("held"), w)) for p in BASE]
    look = F.arrays_overlap("held", F.array(*(F.lit(w) for w in leads)))
    for p in phrase:
        look = look | p
    rows = rows.select(
        F.monotonically_increasing_id().alias("uid"),
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.when(look, F.col("held")).alias("held"),
        F.when(look, F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))).alias("j"),
    )
    rows = written(rows, "licenses")
    joined = rows.where("j is not null").select("uid", "held", "j")
    base = joined.select("uid", F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(v).alias("label")) for p, v in BASE.items()))).alias("b"), "j")
    base = base.where(F.col("j").contains(F.concat(F.lit(" "), F.col("b.p"), F.lit(" "))))
    # Each phrase is cut at its places; a lookahead leaves the space that two places share.
    cut = F.split("j", F.concat(F.lit(" "), F.col("b.p"), F.lit("(?= )")), F.lit(-1))
    lengths = F.transform(cut, lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))))
    base = base.select("uid", "b.label", lengths.alias("gaps"), F.size(F.split("b.p", " ")).alias("k"))
    # Words before place i: the spaces in the gaps so far and the words of the places passed.
    first = F.col("gaps")[0]
    last = F.aggregate(F.slice("gaps", F.lit(1), F.size("gaps") - 1), F.lit(0), lambda a, x: a + x) + F.col("k") * (F.size("gaps") - 2)
    base = base.select("uid", "label", (F.size("gaps") - 1).alias("n"), first.alias("first"), last.alias("last"))
    phrases = base.groupBy("uid").agg(
        F.sum("n").alias("n_base"), F.min("first").alias("first_word"), F.max("last").alias("last_word"), F.collect_set("label").alias("base_set")
    )
    rule = spark.createDataFrame(table, "rule int, lead string, also array<string>, expression string, label string, priority int, confidence double")
    rule = F.broadcast(rule.withColumn("expression", F.concat(F.lit(" "), F.col("expression"), F.lit("(?= )"))))  # a few hundred rows, fixed
    led = joined.select("uid", "held", "j", F.explode(_held("held", leads)).alias("lead"))
    tried = led.join(rule, "lead").where(F.forall("also", lambda w: F.array_contains(F.col("held"), w)))
    # The text between matches, and the matches: their lengths add up to places.
    pieces = F.split("j", F.col("expression"), F.lit(-1))
    tried = tried.withColumn("pieces", pieces).where(F.size("pieces") > 1)
    found = F.regexp_extract_all("j", F.col("expression"), F.lit(0))
    pairs = F.arrays_zip(F.transform("pieces", F.length).alias("gap"), F.transform(found, F.length).alias("hit"))
    hits = tried.select("uid", "rule", "label", "priority", "confidence", F.posexplode(pairs).alias("at", "x")).where("x.hit is not null").repartition("uid")
    so_far = Window.partitionBy("uid", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = hits.withColumn("e", F.sum(F.col("x.gap") + F.col("x.hit")).over(so_far))
    hits = hits.select("uid", "rule", "label", "priority", "confidence", (F.col("e") - F.col("x.hit")).alias("s"), "e")
    # Sorted by start, longest first: whatever holds a detection comes before it.
    before = Window.partitionBy("uid").orderBy("s", F.desc("e"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    top = max(r[5] for r in table)
    reach = [F.max(F.when(F.col("priority") >= level, F.col("e"))).over(before).alias(f"m{level}") for level in range(top + 1)]
    seen = hits.select("*", *reach)
    held_by = F.element_at(F.array(*(F.col(f"m{level}") for level in range(top + 1))), F.col("priority") + 1)
    kept = seen.where(F.coalesce(held_by < F.col("e"), F.lit(True)))
    found = kept.groupBy("uid").agg(F.collect_set("label").alias("rule_set"), F.max("confidence").alias("best"))
    out = rows.select("uid", "doc_id", "n_words").join(phrases, "uid", "left").join(found, "uid", "left")
    none = F.array().cast("array<string>")
    listed = lambda c: F.concat_ws(",", F.array_sort(c))
    base_set, rule_set = F.coalesce("base_set", none), F.coalesce("rule_set", none)
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        listed(base_set).alias("base_labels"),
        listed(F.array_union(base_set, rule_set)).alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size(base_set) > 0, 0.75).otherwise(0.0)).alias("score"),
    )
