"""Licence scan: a trained paragraph classifier with confirmation against templates.

Sparse word n-gram logistic regression (one class per licence family and one for "unknown") is trained on variants of short
templates and on prose and statements that only sound like licences. Probabilities are calibrated by a temperature chosen on held-out
variants; a paragraph whose best family stays under the acceptance level is unknown. A prediction counts only if the
paragraph also shares enough word pairs with one of the family's templates.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.llm.common import texts

# Wording by which licence families are declared or begin.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license. See LICENSE for details.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.", "SPDX-License-Identifier: MIT", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "This project is distributed under the terms of the MIT license.", "The package is MIT licensed."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "SPDX-License-Identifier: Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work.", "Distributed under the Apache 2.0 license."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Released under the GNU General Public License version 2.", "SPDX-License-Identifier: GPL-3.0-or-later", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", "The GNU General Public License is a free, copyleft license for software and other kinds of works.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "Distributed under the terms of the GNU GPL v2 or later.", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: LGPL-2.1-only", "See the GNU Lesser General Public License for more details.", "Distributed under the LGPL v3.", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-2.0-or-later", "LGPL version 3 or later"],
    "AGPL": ["This program is licensed under the GNU Affero General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only", "See the GNU Affero General Public License for more details.", "Distributed under the AGPL v3."],
    "BSD": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Licensed under the 2-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "You may distribute Covered Software in Executable Form under the terms of this License."],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Licensed under the Eclipse Public License, version 1.0.", "SPDX-License-Identifier: EPL-2.0", "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (AGREEMENT). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES ACCEPTANCE OF THIS AGREEMENT."],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Except where noted, content is available under CC BY 4.0.", "Text is available under the Creative Commons Attribution License.", "Images are under a Creative Commons Attribution 2.0 License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License.", "Content is available under CC BY-SA 3.0."],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0 for noncommercial use only.", "Creative Commons Attribution-NonCommercial-NoDerivatives License CC BY-NC-ND"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.", "Dedicated to the public domain under CC0.", "SPDX-License-Identifier: CC0-1.0", "No rights reserved, dedicated under CC0 1.0."],
    "Public-domain": ["This is free and unencumbered software released into the public domain.", "This work is in the public domain. The author disclaims copyright to this source code.", "SPDX-License-Identifier: Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Proprietary": ["All rights reserved.", "Copyright 2020 the authors. All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.", "No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher."],
}
# Statements that sound like licences and are none.
DECOYS = ["A driver license is required at the gate.", "The committee debated a new copyright law and the rights of authors.", "She asked permission to leave the room before noon.", "The warranty on the engine covers all parts for two years.", "You may use the back door when the front is closed.", "He studied at MIT and later moved to Apache county.", "Open source software changed the industry in many ways.", "Please read the terms and conditions of the hotel.", "The public domain of the village includes a park and a mill.", "Fishing licenses are sold under the bridge.", "General rights of the public are described in the next version.", "The free foundation can distribute food to any person without charge.", "mit der und die das version", "licensed plumber released into the wild", "No rights reserved.", "Some rights reserved.", "New rules were released under the last government.", "The seats in the front row are all reserved.", "The program of the evening is available at the door.", "See the general terms for more details.", "Copies of the plan are distributed to everyone in the hall.", "The seller reserved all rights to the garden and the barn.", "They reserved the right to leave.", "All the rights of the heirs were reserved by the court."]
# Declarations of families that TEMPLATES does not hold: what the unknown class is for.
FOREIGN = [
    "Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3.",
    "Licensed under the Artistic License 1.0.", "You may copy and distribute verbatim copies of the Standard Version under the Artistic License.", "Licensed under the EUPL, version 1.1.", "European Union Public Licence, Version 1.2.",
    "DO WHAT YOU WANT TO PUBLIC LICENSE, Version 2", "Licensed under the zlib License.", "This software is provided as-is under the zlib/libpng license.", "Licensed under the Academic Free License version 3.0.",
    "Common Development and Distribution License, Version 1.0.", "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "Released under the PostgreSQL License.", "Licensed under the Open Software License 3.0.", "Microsoft Public License (Ms-PL)",
    "Licensed under the Python Software Foundation License Version 2.", "SPDX-License-Identifier: CDDL-1.0", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: Artistic-1.0", "SPDX-License-Identifier: OFL-1.1", "Server Side Public License, Version 1.",
]
WORD = re.compile(r"[a-z0-9]+")
UNKNOWN = "unknown"
END = re.compile(r"[.!?:;\"”)]\s*$")


def paragraphs(text: str) -> list[tuple[int, int]]:
    """(start, end) of each paragraph: lines up to a blank line or to a line that ends a sentence."""
    out, start, at = [], None, 0
    for line in text.split("\n"):
        end = at + len(line)
        if line.strip():
            start = at if start is None else start
            if END.search(line):
                out.append((start, end))
                start = None
        elif start is not None:
            out.append((start, at - 1))
            start = None
        at = end + 1
    if start is not None:
        out.append((start, len(text)))
    return out


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def pairs(found: list[str]) -> list[tuple[str, str]]:
    return list(zip(found, found[1:]))


def grams(found: list[str]) -> list:
    return [*found, *pairs(found), *zip(found, found[1:], found[2:])]


class LicenceModel:
    def __init__(self, seed: int = 5, variants: int = 40, accept: float = 0.5, similar: float = 0.5):
        self.classes, self.accept, self.similar = [*TEMPLATES, UNKNOWN], accept, similar
        self.shapes = {k: [set(pairs(words(t))) for t in v] for k, v in TEMPLATES.items()}
        self.templates_of: dict[tuple[str, str], list[int]] = {}
        flat = [s for v in self.shapes.values() for s in v]
        for t, s in enumerate(flat):
            for pair in s:
                self.templates_of.setdefault(pair, []).append(t)
        self.sizes, self.known = [len(s) for s in flat], frozenset(self.templates_of)
        rng = random.Random(seed)
        data = [self._example(rng, k, t) for k, v in TEMPLATES.items() for t in v for _ in range(variants)]
        data += [(self._noise(rng, t), UNKNOWN) for t in [*DECOYS, *FOREIGN] for _ in range(variants)] + [(self._prose(rng, rng.randint(1, 60)), UNKNOWN) for _ in range(variants * 12)]
        rng.shuffle(data)
        kept = [d for d in data if d[0]]
        test, train = kept[: len(kept) // 5], kept[len(kept) // 5 :]
        self.held_out = test
        counts = Counter(g for x, _ in train for g in set(grams(x)))
        self.number = {g: k for k, g in enumerate(sorted((g for g, c in counts.items() if c >= 3), key=str))}
        self.weights, self.bias = self._fit(train)
        scores = [self._logits(x) for x, _ in test]
        right = [self.classes.index(y) for _, y in test]
        loss = lambda t: -np.mean([np.log(self._softmax(s * t)[y] + 1e-12) for s, y in zip(scores, right)])
        self.temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
        self.held_out_accuracy = float(np.mean([np.argmax(s) == y for s, y in zip(scores, right)]))

    @staticmethod
    def _prose(rng: random.Random, n: int) -> list[str]:
        bits = "a the of in to and er on th re st ing ed ly le de la que ion ment der die sch ung keit el los ado con".split()
        return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 4))) for _ in range(n)]

    def _noise(self, rng: random.Random, text: str) -> list[str]:
        found = [w for w in words(text) if rng.random() > 0.06]
        return self._prose(rng, rng.choice([0, 0, 0, 3, 12])) + found + self._prose(rng, rng.choice([0, 0, 0, 3, 12]))

    def _example(self, rng: random.Random, name: str, text: str) -> tuple[list[str], str]:
        return self._noise(rng, text), name

    def _vector(self, found: list[str]) -> np.ndarray:
        return np.unique(np.array([self.number[g] for g in grams(found) if g in self.number], np.int64))

    def _logits(self, found: list[str]) -> np.ndarray:
        x = self._vector(found)
        return self.bias + self.weights[x].sum(0) / np.sqrt(max(len(x), 1))

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max())
        return e / e.sum()

    def _fit(self, train: list[tuple[list[str], str]], rounds: int = 8, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
        w, b = np.zeros((len(self.number), len(self.classes))), np.zeros(len(self.classes))
        w2, b2 = np.full_like(w, 1e-2), np.full_like(b, 1e-2)
        coded = [(self._vector(x), self.classes.index(y)) for x, y in train]
        for _ in range(rounds):
            for x, y in coded:
                size = np.sqrt(max(len(x), 1))
                g = self._softmax(b + w[x].sum(0) / size)
                g[y] -= 1
                w2[x] += (g / size) ** 2
                b2 += g**2
                w[x] -= rate * (g / size + 1e-4 * w[x]) / np.sqrt(w2[x])
                b -= rate * g / np.sqrt(b2)
        return w, b

    def may_confirm(self, found: list[str]) -> bool:
        """Whether words are similar enough to any family's template; classify() calls all others unknown."""
        own = self.known.intersection(zip(found, found[1:]))
        if not own:
            return False
        shared = Counter(t for pair in own for t in self.templates_of[pair])
        least = self.similar * len(set(zip(found, found[1:])))
        return any(n >= self.similar * self.sizes[t] or n >= least for t, n in shared.items())

    def classify(self, paragraph: str) -> tuple[str, float, float]:
        """(family or "unknown", calibrated probability, similarity to the family's nearest template)."""
        found = words(paragraph)
        p = self._softmax(self._logits(found) * self.temperature)
        k = int(np.argmax(p))
        family = self.classes[k]
        if family == UNKNOWN or p[k] < self.accept:
            return UNKNOWN, float(p[-1]), 0.0
        own = set(pairs(found))
        similarity = max((max(len(own & s) / len(s), len(own & s) / max(len(own), 1)) for s in self.shapes[family]), default=0.0)
        return (family if similarity >= self.similar else UNKNOWN), float(p[k]), similarity


@lru_cache(1)
def default_model() -> LicenceModel:
    return LicenceModel()


def find_licences(text: str, model: LicenceModel) -> list[tuple[int, int, int, str, float, float]]:
    """(paragraph, start, end, family, probability, similarity) of each paragraph that declares a licence."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out = []
    for k, (start, end) in enumerate(paragraphs(text)):
        part = low[start:end]
        if model.may_confirm(WORD.findall(part)):
            family, p, similarity = model.classify(part)
            if family != UNKNOWN:
                out.append((k, start, end, family, p, similarity))
    return out


def scan_licences(docs: DataFrame, model: LicenceModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_found, families (distinct, sorted), and found: array of
    (paragraph, start, end, family, probability, similarity).

    A null text is empty and declares nothing; so does a text without a confirmed paragraph. Whole texts are read; repeated
    rows and rows without an id are scanned each; other columns are ignored.
    """
    model = model or default_model()
    spot = pa.struct([("paragraph", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("found", pa.list_(spot))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("paragraph", "start", "end", "family", "probability", "similarity"), x)) for x in find_licences(t.as_py(), model)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, schema.field(1).type)], schema=schema)

    rows = texts(docs, id_col, text_col).mapInArrow(scan, "doc_id long, found array<struct<paragraph:int,start:int,end:int,family:string,probability:double,similarity:double>>")
    return rows.select("doc_id", F.size("found").cast("long").alias("n_found"), F.array_sort(F.array_distinct("found.family")).alias("families"), "found")
