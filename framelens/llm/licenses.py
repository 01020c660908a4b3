"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelens.llm.containment import BLOCK_ITEMS, Blocks, Rule, find

#: The wording of common license notices.
TEMPLATES = (
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("MIT", "grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "notice", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "notice", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "waiver", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("EPL-2.0", "header", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "grant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("Zlib", "notice", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Unlicense", "grant", "This is free and unencumbered software released into the public domain."),
)
#: Words are runs of letters, digits and bytes beyond ASCII, so punctuation and line ends don't matter.
RULE = Rule(threshold=0.8, words=5, breaks=bytes(b for b in range(128) if not chr(b).isalnum()))


def scan(docs: DataFrame, templates=TEMPLATES, rule: Rule = RULE) -> DataFrame:
    """(doc_id, license, part, template, n_shingles, n_shared, containment, first_word, best) of every license text found.

    A template, numbered by its place in ``templates``, is found if the document's five-word shingles
    hold at least 0.8 of its distinct ones; ``first_word`` is the first word of the first shared
    shingle.  Of templates with one first word, such as two versions of a license, ``best`` marks those
    with the highest containment.  A null or empty text has none; a repeated row gives its rows again; an empty table gives
    none; other columns are not read.
    """
    spark = docs.sparkSession
    blocks = Blocks(spark, ((list(range(lo, min(lo + BLOCK_ITEMS, len(templates)))), [t[2].encode() for t in templates[lo : lo + BLOCK_ITEMS]]) for lo in range(0, max(1, len(templates)), BLOCK_ITEMS)), T.IntegerType())
    names = spark.createDataFrame([(i, t[0], t[1]) for i, t in enumerate(templates)], "item int, license string, part string")
    found = find(docs, blocks, rule).join(F.broadcast(names), "item")
    return found.select("doc_id", "license", "part", F.col("item").alias("template"), "n_shingles", "n_shared", "containment", "first_word", "best")
