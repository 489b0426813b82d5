"""Licence and main-text queries against plain versions, and on wordings and layouts that their training data do not hold."""

import re

import numpy as np

from docket.llm import licences, mainpage, queries

SF = "/root/testdata/sf0.001"
# Written for this test; none is a training template.
WORDINGS = [
    ("MIT", "The code in this repository is published under the MIT License."),
    ("MIT", "MIT License"),
    ("MIT", "Licensed under MIT, see the LICENSE file."),
    ("Apache-2.0", "Source code is available under the Apache License 2.0."),
    ("Apache-2.0", "This project uses the Apache License, Version 2.0."),
    ("GPL", "Distributed under the GNU General Public License v3."),
    ("GPL", "You should have received a copy of the GNU General Public License along with this program."),
    ("LGPL", "This library is distributed under the GNU Lesser General Public License."),
    ("AGPL", "The server is licensed under the GNU Affero General Public License version 3."),
    ("BSD", "This software is released under the 2-clause BSD license."),
    ("BSD", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Released under the ISC License."),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL", "Made available under the Eclipse Public License 2.0."),
    ("CC-BY", "Photos are licensed under a Creative Commons Attribution 3.0 License."),
    ("CC-BY-SA", "This article is available under a Creative Commons Attribution-ShareAlike 3.0 License."),
    ("CC-BY-NC", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 License."),
    ("CC0", "Dedicated to the public domain under CC0 1.0."),
    ("Public-domain", "This software is released into the public domain."),
    ("Proprietary", "Copyright 2015 Example Corp. All rights reserved."),
    ("Proprietary", "Unauthorized copying of this document is strictly prohibited."),
    ("GPL", "Everyone is permitted to copy and distribute verbatim copies of this license document."),
    ("unknown", "No rights reserved."),
    ("unknown", "She holds a license to drive heavy trucks."),
    ("unknown", "All seats are reserved for members of the public."),
    ("unknown", "The warranty covers parts and labour for two years."),
    ("unknown", "Permission to park was granted by the office."),
    ("unknown", "The Apache helicopter flew over the free state."),
    ("unknown", "The copyright debate went on in all member states."),
    ("unknown", "He was released under the new rules."),
]


def plain_licences(text, model):
    """Families of a text: every paragraph scored by hand, with no paragraph skipped."""
    out, block = set(), []
    for line in [*text.split("\n"), ""]:
        if line.strip():
            block.append(line)
        if block and (not line.strip() or re.search(r"[.!?:;\"”)]\s*$", line)):
            found = re.findall("[a-z0-9]+", "\n".join(block).lower())
            grams = {*found, *zip(found, found[1:]), *zip(found, found[1:], found[2:])} & set(model.number)
            z = np.array(model.bias)
            for g in grams:
                z = z + model.weights[model.number[g]] / np.sqrt(max(len(grams), 1))
            p = np.exp(z * model.temperature - (z * model.temperature).max())
            p /= p.sum()
            own = set(zip(found, found[1:]))
            near = any(2 * len(own & s) >= min(len(s), max(len(own), 1)) for s in model.shapes.get(model.classes[int(p.argmax())], ()))
            if p.max() >= 0.5 and near:
                out.add(model.classes[int(p.argmax())])
            block = []
    return out


def test_licence_query_equals_the_plain_version(spark):
    model = licences.default_model()
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.families for r in queries.op6_licences(spark, SF).collect()}
    assert set(got) == set(rows)
    for i, text in rows.items():
        assert got[i] == ",".join(sorted(plain_licences(text, model))), i


def test_licences_of_new_wordings():
    model = licences.default_model()
    assert not {t for _, t in WORDINGS} & {t for v in licences.TEMPLATES.values() for t in v}
    found = [[x[3] for x in licences.find_licences(t, model)] or ["unknown"] for _, t in WORDINGS]
    assert sum(f == [family] for f, (family, _) in zip(found, WORDINGS)) >= 0.9 * len(WORDINGS)


def test_main_text_query_gives_the_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op9_main_text(spark, SF).collect()}
    assert len(got) == len(pages)
    for r in pages:
        article = re.search(r"<article[^>]*>(.*?)</article>", r.html or "", re.S)
        want = " ".join(b.text for b in mainpage.leaf_blocks(article[1])) if article else ""
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_main_text_of_layouts_without_telling_names():
    model = mainpage.default_model()
    menu = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">About us</a></li></ul></nav>'
    body = "<h1>A fine day in the hills</h1><p>We walked up the road early and saw the mill.</p><p>It was closed, but the miller came out and showed us the wheel.</p>"
    want = "A fine day in the hills We walked up the road early and saw the mill. It was closed, but the miller came out and showed us the wheel."
    for begin, end in (('<div class="c1">', "</div>"), ("<div>", "</div>"), ('<div id="x7">', "</div>"), ("<section><div>", "</div></section>")):
        assert mainpage.main_text(f"<html><body>{menu}{begin}{body}{end}<footer>&copy; 2020 Someone</footer></body></html>", model) == want
    page = "<article><h1>Head line</h1><template-box>x</template-box><p>The rest stays.</p><object-card>y</object-card><p>And this.</p><script-x>z</script-x></article>"
    assert [b.text for b in mainpage.leaf_blocks(page)] == ["Head line", "x", "The rest stays.", "y", "And this.", "z"]


def test_main_text_of_odd_pages():
    """Comments, boxes and controls inside the main column go; columns without names and text without tags stay."""
    model = mainpage.default_model()
    body = "<p>The quick brown fox jumped over the lazy dog and went home.</p><p>It then slept for a long while, until the morning came around.</p>"
    text = "The quick brown fox jumped over the lazy dog and went home. It then slept for a long while, until the morning came around."
    menu = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>About us</a></li></ul>"
    cases = [
        (f"<article><h1>Head line</h1>{body}<div class='comments'><p>Nice article, thanks a lot.</p><p>I do not agree with this.</p></div></article>", "Head line " + text),
        (f"<article><h1>Head line</h1>{body}<div class='newsletter'><p>Sign up for our newsletter.</p></div></article>", "Head line " + text),
        (f"<article>{body}</article><textarea>typed</textarea><button>Send</button><select><option>Share</option></select>", text),
        (f"<article>{body}<textarea>typed</textarea><button>Send</button></article>", text),
    ]
    for page, want in cases:
        assert mainpage.main_text(f"<html><body>{page}</body></html>", model) == want
    assert mainpage.main_text(f"<div><div>{body}</div><div>{menu}</div></div>", model) == text
    assert mainpage.main_text(text, model) == text


def test_licences_of_other_families():
    """Families that no template holds, in wordings that training does not hold either, are unknown; identifiers tell LGPL from GPL."""
    model = licences.default_model()
    cases = [
        ("Boost Software License - Version 1.0", None), ("GNU Free Documentation License", None), ("Artistic License 2.0", None), ("Licensed under the EUPL", None), ("WTFPL", None), ("Released under the zlib license", None),
        ("Code is available under the SIL Open Font License.", None), ("He reserved all rights to the house.", None), ("SPDX-License-Identifier: Artistic-2.0", None), ("SPDX-License-Identifier: LGPL-3.0-or-later", "LGPL"),
        ("SPDX-License-Identifier: GPL-2.0-only", "GPL"), ("SPDX-License-Identifier: AGPL-3.0-or-later", "AGPL"), ("This software is MIT licensed.", "MIT"),
    ]
    training = {t for v in licences.TEMPLATES.values() for t in v} | {*licences.DECOYS, *licences.FOREIGN}
    assert not training & {t for t, _ in cases}
    for text, family in cases:
        assert [x[3] for x in licences.find_licences(text, model)] == ([family] if family else []), text
