"""Licence scans by sentence rules, in DataFrame operations only.

Texts are cut into sentences, which are normalised and mapped to the identifiers of known licence
sentences; a licence is found where the identifiers of one of its rules follow each other in order,
at most ``GAP`` sentences apart. Known sentences are cut as texts are; their pieces must be adjacent.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm._work import table, written

#: Sentences from one of a rule's sentences to the next, at most.
GAP = 3

#: Known sentences by identifier. The wording of the public licence texts and of usual notices.
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "mit-notice-3": "This project is licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2-grant": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-2-use": "you may not use this file except in compliance with the License.",
    "apache-2-copy": "You may obtain a copy of the License at",
    "gpl-3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "cc-by-nc-4-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4-notice": "Licensed under CC BY-SA 4.0.",
    "cc0-notice": "Released under CC0 1.0.",
    "bsd-use": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "mit-0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-old": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "postgresql-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "wtfpl-copy": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "mpl-2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-2-copy-2": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
    "gpl-2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl-3-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
    "lgpl-2-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "library-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-see": "See the GNU Lesser General Public License for more details.",
    "agpl-see": "See the GNU Affero General Public License for more details.",
    "apache-2-head": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "apache-2-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "cc-by-4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nd-4-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-sa-4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc0-waived": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2-notice": "This work is licensed under the GNU General Public License, version 2.",
    "bsd-2-notice": "Licensed under the BSD 2-Clause License.",
    "bsd-3-notice": "Licensed under the BSD 3-Clause License.",
    "mpl-2-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "isc-notice": "Licensed under the ISC License.",
}

#: Rules: (licence, identifiers in order).
RULES = (
    ("MIT", ("mit-notice",)), ("MIT", ("mit-notice-2",)), ("MIT", ("mit-notice-3",)), ("MIT", ("mit-grant", "mit-condition")),
    ("Apache-2.0", ("apache-2-notice",)), ("Apache-2.0", ("apache-2-grant", "apache-2-use", "apache-2-copy")),
    ("GPL-3.0", ("gpl-3-notice",)), ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-notice",)), ("CC-BY-4.0", ("cc-by-4-notice",)), ("CC-BY-SA-4.0", ("cc-by-sa-4-notice",)), ("CC0-1.0", ("cc0-notice",)),
    ("BSD-2-Clause", ("bsd-use", "bsd-source", "bsd-binary")), ("BSD-3-Clause", ("bsd-use", "bsd-source", "bsd-binary", "bsd-endorse")), ("Unlicense", ("unlicense",)),
    ("MIT-0", ("mit-0-grant",)), ("ISC", ("isc-grant",)), ("ISC", ("isc-grant-old",)), ("0BSD", ("0bsd-grant",)), ("PostgreSQL", ("postgresql-grant",)), ("BSL-1.0", ("bsl-grant",)), ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")), ("WTFPL", ("wtfpl-copy",)),
    ("MPL-2.0", ("mpl-2-form", "mpl-2-copy")), ("MPL-2.0", ("mpl-2-form", "mpl-2-copy-2")), ("EPL-2.0", ("epl-2",)), ("GPL-2.0-or-later", ("gpl-2-free", "gpl-hope", "gpl-see")), ("GPL-2.0-only", ("gpl-2-only",)), ("GPL-3.0-only", ("gpl-3-only",)),
    ("LGPL-2.1-or-later", ("lgpl-2-free", "library-hope", "lgpl-see")), ("LGPL-3.0-or-later", ("lgpl-3-free", "gpl-hope", "lgpl-see")), ("AGPL-3.0-or-later", ("agpl-3-free", "gpl-hope", "agpl-see")), ("Apache-2.0", ("apache-2-head", "apache-2-terms")),
    ("CC-BY-4.0", ("cc-by-4-work",)), ("CC-BY-SA-4.0", ("cc-by-sa-4-work",)), ("CC-BY-ND-4.0", ("cc-by-nd-4-work",)), ("CC-BY-NC-4.0", ("cc-by-nc-4-work",)), ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4-work",)), ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4-work",)), ("CC0-1.0", ("cc0-waived",)),
    ("GPL-2.0", ("gpl-2-notice",)), ("BSD-2-Clause", ("bsd-2-notice",)), ("BSD-3-Clause", ("bsd-3-notice",)), ("MPL-2.0", ("mpl-2-notice",)), ("ISC", ("isc-notice",)),
)

#: A sentence ends at a line's end that another sentence's sign precedes, at an empty line, or after such a sign before a blank.
ENDS = r"(?<=[.!?:;])[ \t\r\n]+|\n[ \t\r]*\n"
#: Comment signs at a line's start, and at its end after a blank. Without them an empty comment line is an empty line.
COMMENTS = r"(?md)^[ \t]*(?:#+|//+[/!]*|/\*+|\*+/?|--+>?|;+|%+|<!--+)+|[ \t]+(?:\*+/?|#+|--+>)[ \t\r]*$"
#: Runs of whatever is neither letter nor digit are one blank.
NOISE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), NOISE, " "))


def bare(text: Column) -> Column:
    """The text without comment signs."""
    return F.regexp_replace(text, COMMENTS, "")


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: tuple = RULES, gap: int = GAP) -> DataFrame:
    """id, t (hash of the text), rule, licence: the rules that each text meets.

    Sentences may run over lines; a line by itself also counts as a sentence for rules of one piece. Of
    the places where a rule can begin for one end, the last is followed up. A rule that begins where a
    longer rule with the same first sentences is met isn't met by itself.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).select("id", F.xxhash64("text").alias("t"), bare(F.col("text")).alias("text"))
    cut = base.select("id", "t", F.posexplode(F.split("text", ENDS)).alias("pos", "s")).select("id", "t", "pos", normal(F.col("s")).alias("s"))
    pieces = {k: [x for x in re.split(ENDS, v) if x.strip()] for k, v in sentences.items()}
    known = spark.createDataFrame([(f"{k} {i}", x) for k, v in pieces.items() for i, x in enumerate(v)], "sid string, s string").select("sid", normal(F.col("s")).alias("s"))
    # The pieces of each rule, each with its distance from the one before at most.
    parts = [[(f"{k} {i}", 1 if i else gap) for k in ids for i in range(len(pieces[k]))] for _, ids in rules]
    steps = spark.createDataFrame([(r, rules[r][0], i, sid, reach, len(own)) for r, own in enumerate(parts) for i, (sid, reach) in enumerate(own)], "rule int, licence string, step int, sid string, reach int, of int")
    lines = base.select("id", "t", F.explode(F.split("text", "\n")).alias("s")).select("id", "t", F.lit(-1).alias("pos"), normal(F.col("s")).alias("s"))
    named = lambda rows: rows.join(F.broadcast(known), "s").select("id", "t", "pos", "sid").join(F.broadcast(steps), "sid")
    hits = written(named(cut).union(named(lines).filter("of = 1")), spark)
    now = hits.filter("step = 0").select("id", "t", "rule", "licence", "of", F.col("pos").alias("start"), F.col("pos").alias("end"))
    done = now.filter("of = 1")
    for step in range(1, max(len(own) for own in parts)):
        then = hits.filter(F.col("step") == step).select(F.col("id").alias("id_"), F.col("t").alias("t_"), F.col("rule").alias("rule_"), "pos", "reach")
        on = F.col("id").eqNullSafe(F.col("id_")) & (F.col("t") == F.col("t_")) & (F.col("rule") == F.col("rule_")) & (F.col("pos") > F.col("end")) & (F.col("pos") <= F.col("end") + F.col("reach"))
        now = now.join(then, on).groupBy("id", "t", "rule", "licence", "of", "pos").agg(F.max("start").alias("start")).select("id", "t", "rule", "licence", "of", "start", F.col("pos").alias("end"))
        done = done.union(now.filter(F.col("of") == step + 1))
    longer = [(i, j) for i, (_, x) in enumerate(rules) for j, (_, y) in enumerate(rules) if len(x) < len(y) and y[: len(x)] == x]
    if longer:
        done = written(done, spark)
        over = done.join(F.broadcast(spark.createDataFrame(longer, "less int, rule int")), "rule").select(F.col("id").alias("id_"), F.col("t").alias("t_"), F.col("less").alias("rule_"), F.col("start").alias("start_")).distinct()
        done = done.join(over, F.col("id").eqNullSafe(F.col("id_")) & (F.col("t") == F.col("t_")) & (F.col("rule") == F.col("rule_")) & (F.col("start") == F.col("start_")), "left_anti")
    return done.select("id", "t", "rule", "licence").distinct()


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """id, n_sentences, licences (sorted, distinct), n_rules for each input row.

    Null texts have no sentences and no licences; repeated rows get equal rows; null ids are kept
    apart by their text.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = matches(docs, id_col, text_col, **more).groupBy("id", "t").agg(F.array_sort(F.collect_set("licence")).alias("licences"), F.count("*").alias("n"))
    found = written(found.select(F.col("id").alias("id_"), F.col("t").alias("t_"), "licences", "n"), docs.sparkSession)
    rows = base.select("id", F.xxhash64("text").alias("t"), F.coalesce(F.size(F.split(bare(F.col("text")), ENDS)), F.lit(0)).alias("n_sentences"))
    rows = rows.withColumn("n_sentences", F.greatest("n_sentences", F.lit(0)).cast("bigint"))
    out = rows.join(found, F.col("id").eqNullSafe(F.col("id_")) & (F.col("t") == F.col("t_")), "left")
    return out.select("id", "n_sentences", F.coalesce("licences", F.array().cast("array<string>")).alias("licences"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_rules"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licences."""
    out = scanned(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_sentences", F.array_join("licences", ",").alias("licences"), "n_rules")
