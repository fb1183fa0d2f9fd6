"""Licence notices as files carry them: wrapped, behind comment marks, far down a long text."""

import textwrap

import numpy as np
import pytest

from scoreloom.llm import licenses


@pytest.fixture(scope="module")
def classifier(spark, small):
    return licenses.train_classifier(spark.read.parquet(f"{small}/documents.parquet"))


@pytest.fixture(scope="module")
def prose(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").where("doc_id % 3 = 0 AND n_chars > 300").collect()
    found = [r["text"].replace("\n", " ") for r in rows if "icens" not in r["text"] and "CC" not in r["text"]]
    return " ".join(found).split()


LONG_NOTICES = {
    family: max(notices, key=len) for family, notices in licenses.TEMPLATES.items() if max(map(len, notices)) > 80
}


@pytest.mark.parametrize("family", sorted(LONG_NOTICES))
@pytest.mark.parametrize("width", [60, 76])
@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_wrapped_notice(classifier, prose, family, width, mark):
    lines = [mark + x for x in textwrap.wrap(LONG_NOTICES[family], width)]
    far = textwrap.wrap(" ".join(prose[:3000]), 70)
    text = "\n".join([*far, mark.rstrip(), *lines, mark.rstrip(), *textwrap.wrap(" ".join(prose[3000:3400]), 70)])
    found = classifier.search(text.encode())
    assert [f["family"] for f in found] == [family]
    assert found[0]["similarity"] >= 0.9 and found[0]["paragraph"] >= 1
    assert [f["family"] for f in classifier.search("\r\n".join(lines).encode())] == [family]


def test_short_notices_inside_a_paragraph(classifier, prose):
    for notice, family in (("Released under the MIT License.", "MIT"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0")):
        text = " ".join([*prose[:200], *notice.split(), *prose[200:400]])
        assert [f["family"] for f in classifier.search(textwrap.fill(text, 70).encode())] == [family]


def test_families_that_differ_in_one_word(classifier):
    both = LONG_NOTICES["GPL-2.0"] + "\n\n" + LONG_NOTICES["LGPL"]
    assert [f["family"] for f in classifier.search(both.encode())] == ["GPL-2.0", "LGPL"]


def test_read_against_plain_windows(classifier, prose):
    """Every window scored on its own, without running sums."""
    text = " ".join(prose[:90]) + "\n" + LONG_NOTICES["BSD"] + "\n \n#\n" + " ".join(prose[90:140]) + "\n\nSPDX-License-Identifier: ISC\n"
    parts, held = [], []
    for line in [*text.split("\n"), ""]:
        words = licenses.tokens(line.encode())
        held += words
        if not words and held:
            parts.append(held)
            held = []
    best, unlike, count = {}, [], 0
    for number, words in enumerate(parts):
        for size, step in licenses.SCALES:
            if size == licenses.SCALES[1][0] and len(words) <= licenses.SCALES[0][0]:
                continue
            for at in range(0, max(1, len(words) - size + step), step):
                count += 1
                p = np.round(classifier.probabilities(words[at : at + size]), 6)
                if p[1:].max() < licenses.FLOOR:
                    continue
                around = words[max(0, at - classifier.reach) : at + size + classifier.reach]
                near = {f: [t.similarity(around) for t in ts] for f, ts in classifier.templates.items()}
                if max(s for x in near.values() for s, _ in x) < licenses.UNLIKE:
                    unlike.append(int(p[1:].max() * licenses.BINS))
                    continue
                for c, f in enumerate(licenses.FAMILIES, 1):
                    s = max((s for s, own in near[f] if own), default=0)
                    if p[c] >= licenses.FLOOR and s >= licenses.CONFIRMED:
                        best.setdefault(f, []).append((p[c], number, s))
    found, got_unlike, got_count = classifier.read(text.encode())
    assert {f["family"] for f in found} == set(best) == {"BSD", "ISC"}
    for f in found:
        assert abs(f["probability"] - max(best[f["family"]])[0]) < 1e-5 and f["paragraph"] in {n for _, n, _ in best[f["family"]]}
    assert sorted(got_unlike) == sorted(unlike) and got_count == count


def test_rounds_of_a_long_text(classifier, prose, monkeypatch):
    text = (" ".join(prose[:2000]) + " " + LONG_NOTICES["MPL-2.0"] + " " + " ".join(prose[2000:4000])).encode()
    whole = classifier.read(text)
    monkeypatch.setattr(licenses, "ROUND", 64)
    assert classifier.read(text) == whole


def test_threshold_counts_all_windows(spark):
    schema = licenses.FOUND
    rows = [(1, [], [900, 400], 3000), (2, [], [700], 1000), (3, [], [], 0)]
    assert licenses.least_probability(spark.createDataFrame(rows, schema)) == 0.401
    assert licenses.least_probability(spark.createDataFrame(rows[1:], schema)) == 0.701
    assert licenses.least_probability(spark.createDataFrame([], schema)) == licenses.FLOOR


def test_paragraphs():
    words, _, edges = licenses.paragraphs(b"\n\na b\nc\n * \nd\r\n\r\n\r\ne")
    assert words == [b"a", b"b", b"c", b"d", b"e"] and edges.tolist() == [0, 3, 4, 5]
    assert licenses.paragraphs(b" \n")[0] == [] and licenses.paragraphs(b"")[0] == []
