"""Licence scans: the notices that documents hold, wrapped texts, and several notices in one line."""

import math
import textwrap

import pytest

from lociflow.llm import license_scan

NOTICES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Proprietary": "All rights reserved.",
}


@pytest.fixture(scope="module")
def scanner():
    return license_scan.train(["the quick brown fox jumps over the lazy dog and is not licensed to do so in public"] * 30)


def test_all_five_notices_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {i: {k for k, n in NOTICES.items() if n in t} for i, t in texts.items()}
    assert sum("Proprietary" in w for w in want.values()) == 7
    assert {r.doc_id: set(r.families) for r in license_scan.scan_documents(docs).collect()} == want


def test_short_notice_alone(scanner):
    assert [x[2] for x in scanner.scan("some words go before it\nAll rights reserved.\nand after")] == ["Proprietary"]
    assert not scanner.scan("all the rights were reserved for later")


@pytest.mark.parametrize("mark", ["", "// ", " * ", "# ", "dnl "])
def test_wrapped_texts(scanner, mark):
    for family, texts in license_scan.TEMPLATES.items():
        for t in texts:
            for width in (44, 72):
                lines = textwrap.wrap(t, width, break_long_words=False, break_on_hyphens=False)
                body = "int main()\n" + "\n".join(mark + x for x in lines) + "\n\nreturn 0;"
                for text in (body, body.replace("\n", "\r\n")):
                    found = scanner.scan(text)
                    assert [x[2] for x in found] == [family], (t, width)
                    start, end = found[0][:2]
                    assert lines[0].split()[0].strip('("') in text[start:end] and lines[-1].split()[-1].strip('".,)') in text[start:end]


def test_every_family_of_a_line(scanner):
    assert [x[2] for x in scanner.scan("Released under the MIT License. Licensed under the Apache License, Version 2.0.")] == ["MIT", "Apache-2.0"]
    texts = [(k, t) for k, ts in license_scan.TEMPLATES.items() for t in ts if t != "All rights reserved."]
    assert [x[2] for x in scanner.scan(" ".join(t for _, t in texts))] == [k for k, _ in texts]
    twice = license_scan.TEMPLATES["ISC"][1]
    found = scanner.scan(f"{twice} {twice}")
    assert [x[:3] for x in found] == [(0, len(twice), "ISC"), (len(twice) + 1, 2 * len(twice) + 1, "ISC")]


def test_scores_are_against_unknown(scanner):
    for k, (family, texts) in enumerate(license_scan.TEMPLATES.items(), 1):
        for t in texts:
            z = scanner.bias + scanner.weights[scanner.features(license_scan._tokens(t.lower()))].sum(axis=0)
            (found,) = scanner.scan(t)
            assert found[3] == pytest.approx(1 / (1 + math.exp((z[0] - z[k]) / scanner.temperature)), abs=1e-6), family
