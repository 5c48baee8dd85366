"""Licences wrapped over lines, with other text around them."""

import re
import textwrap

from tessella.llm import license_scan as scan

FILLER = ["Notes on the harbour and its boats.", "The tide came in at nine in the morning.", "", "Nobody had seen the keys since Tuesday."]
MANY = [f"Boat {i} left pier {i + 1} at dawn and came home with {i + 2} crates of fish." for i in range(30)]


def wrapped(text, width=72):
    return textwrap.wrap(text, width)


def grams(text):
    kept = re.sub(r"[^\w.-]+|_+", " ", text.lower())
    words = [w.strip(".-") for w in kept.split()]
    words = [w for w in words if w]
    return {(a, b) for a, b in zip(words, words[1:])}


def brute(text, template):
    """The largest coefficient over all runs of two or more lines."""
    lines, t = text.split("\n"), grams(template)
    best = 0.0
    for i in range(len(lines)):
        for j in range(i + 1, len(lines)):
            b = grams("\n".join(lines[i : j + 1]))
            best = max(best, 2 * len(b & t) / (len(b) + len(t)) if b else 0.0)
    return best


def found(spark, texts, **kw):
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in scan.license_scan(t, **kw).collect()}


def test_wrapped_licences_are_found(spark):
    known = [*scan.TEMPLATES, *scan.WHOLE]
    long = [(n, t) for n, t in known if len(t) > 300 and t != scan._ISC]
    texts = ["\n".join([*MANY[:15], *wrapped(t, 40 + 8 * i), *MANY[15:]]) for i, (_, t) in enumerate(long)]
    got = found(spark, texts)
    for i, (name, t) in enumerate(long):
        assert got[i]["licenses"] == [name], (name, got[i]["licenses"])
        assert got[i]["n_matches"] == 1 and abs(got[i]["best"] - brute(texts[i], t)) < 1e-9


def test_runs_agree_with_brute_force(spark):
    mit = wrapped(scan._MIT, 60)
    texts = [
        "\n".join(FILLER + mit + FILLER),
        "\n".join(FILLER + [x for k, x in enumerate(mit) if k % 6 != 2] + FILLER),  # lines lost
        "\n".join(FILLER + [x for k, x in enumerate(mit) if k % 2] + FILLER),  # half of them
        "\n".join(y for x in mit for y in (x, "")),  # empty lines between
        "\n".join(FILLER + mit[:6] + FILLER * 4 + mit[6:]),  # torn apart
        "\n".join(FILLER * 5),
        "\n".join((FILLER + mit) * 20),  # many copies
        "\n".join(w for x in mit for w in x.split()) + "\nend of it\nand more",  # a word a line
    ]
    got = found(spark, texts, templates=[("MIT", scan._MIT)])
    for i, text in enumerate(texts):
        lines = grams(text.replace("\n", " "))
        t = grams(scan._MIT)
        whole = 2 * len(lines & t) / (len(lines) + len(t))
        best = whole if whole >= 0.8 else brute(text, scan._MIT) if i != 6 else 1.0
        want = best if best >= 0.8 else 0.0
        assert abs(got[i]["best"] - want) < 1e-9, (i, got[i]["best"], want)
        assert got[i]["licenses"] == (["MIT"] if want else []) and got[i]["n_matches"] == bool(want)


def test_a_notice_over_two_lines_and_beside_one_in_a_line(spark):
    gpl2, gpl3 = (f"This work is licensed under the GNU General Public License, version {v}." for v in (2, 3))
    texts = ["Head.\nThis work is licensed under the\nGNU General Public License, version 2.\nTail of a text.", "\n".join([gpl2, "Yes", *MANY]), "\n".join([*MANY, gpl3, "Tail."]), "\n\n\n", "one\ntwo", None]
    got = found(spark, texts)
    assert [got[i]["licenses"] for i in range(6)] == [["GPL-2.0"], ["GPL-2.0"], ["GPL-3.0"], [], [], []]
    assert [got[i]["n_matches"] for i in range(6)] == [1, 1, 1, 0, 0, 0]


def test_two_wrapped_licences_of_one_text(spark):
    bsd2, isc = scan._BSD_HEAD + scan._BSD_TAIL, scan._ISC_WHOLE
    text = "\n".join([*FILLER, *wrapped(bsd2), *FILLER, *wrapped(isc), *FILLER])
    got = found(spark, [text])[0]
    assert got["licenses"] == ["BSD-2-Clause", "ISC"] and got["n_matches"] == 2


def test_a_long_text_of_copies_ends(spark):
    text = "\n".join((FILLER + wrapped(scan._MIT)) * 300)
    assert found(spark, [text])[0]["licenses"] == ["MIT"]
