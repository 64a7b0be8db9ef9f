import random
from collections import Counter

import pytest

from voxloom.llm import decontaminate as de
from voxloom.llm import licenses


def closest(pattern, text):
    column, best = list(range(len(pattern) + 1)), (len(pattern), 0)
    for j, c in enumerate(text, 1):
        after = [0]
        for i, x in enumerate(pattern, 1):
            after.append(min(column[i - 1] + (x != c), column[i] + 1, after[-1] + 1))
        column = after
        best = min(best, (column[-1], j))
    return best


def test_myers_matches_dynamic_programming():
    rng = random.Random(1)
    for _ in range(1500):
        p = "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 20)))
        assert (de.Pattern(p).best(t, len(p) - 1) or (len(p), 0)) == closest(p, t)


def test_no_passage_within_the_budget_is_missed():
    rng = random.Random(2)
    letters = "abcdefgh "
    items = [(i, de.normal("".join(rng.choice(letters) for _ in range(rng.randint(20, 120))))) for i in range(15)]
    block = de.Items(items)
    for _ in range(250):
        i, item = rng.choice(items)
        edited = list(item)
        for _ in range(rng.randint(0, len(item) // de.EDIT_SHARE + 2)):
            at = rng.randrange(len(edited))
            rng.choice([lambda: edited.insert(at, "z"), lambda: edited.pop(at), lambda: edited.__setitem__(at, "z")])()
        text = de.normal("".join(rng.choice(letters) for _ in range(40)) + "".join(edited) + "".join(rng.choice(letters) for _ in range(40)))
        want = {k: closest(t, text)[0] for k, t in items if closest(t, text)[0] <= len(t) // de.EDIT_SHARE}
        found = block.matches(text)
        assert {k: d for k, d, _, _ in found} == want
        for k, d, a, b in found:
            assert closest(dict(items)[k], text[a:b])[0] == d


def test_no_passage_of_a_repeated_phrase_is_missed():
    text = "so he said 2o be or nxt to be or not to be, that is the que and left"
    item = "to be or not to be or not to be, that is the que"
    assert [(k, d) for k, d, _, _ in de.Items([(1, item)]).matches(text)] == [(1, 2)]
    rng = random.Random(5)
    for _ in range(400):
        phrases = ["".join(rng.choice("abc ") for _ in range(rng.randint(3, 9))) for _ in range(2)]
        item = de.normal("".join(rng.choice(phrases) for _ in range(rng.randint(5, 12))))
        edited = list(item)
        for _ in range(rng.randint(0, len(item) // de.EDIT_SHARE + 1)):
            edited[rng.randrange(len(edited))] = "z"
        text = de.normal("".join(rng.choice(phrases) for _ in range(3)) + " y " + "".join(edited) + " y " + "".join(rng.choice(phrases) for _ in range(3)))
        want, found = closest(item, text)[0], de.Items([(1, item)]).matches(text)
        assert [d for _, d, _, _ in found] == ([want] if want <= len(item) // de.EDIT_SHARE else [])
        assert all(closest(item, text[a:b])[0] == d for _, d, a, b in found)


def test_passages_and_clean(spark, table):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog near the river bank."), (2, None), (3, "")], "item_id bigint, text string")
    docs = table([(1, "x the QUICK brown\nfox jumps over the lazy dog near the river bank. y"), (2, "the quick brawn fox jumps over the lazy dog near the rivr bank."), (3, "the quick brown fox"), (4, None), (5, ""), (None, "clean")])
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in de.passages(docs, bench).collect())
    assert got == [(1, 1, 0), (2, 1, 2)]
    assert sorted(r["doc_id"] or 0 for r in de.clean(docs, bench).collect()) == [0, 3, 4, 5]
    assert de.passages(docs, bench, block=1).count() == 2  # an item is a block alone
    none = bench.where("false")
    assert de.passages(docs, none).count() == 0 and de.clean(docs, none).count() == 6 and de.passages(docs.where("false"), bench).count() == 0


def test_edges(edges, spark):
    bench = spark.createDataFrame([(1, "cat sat on the mat")], "item_id bigint, text string")
    odd = edges.withColumnRenamed("lang", "item_id").withColumnRenamed("source", "distance")
    assert sorted(r["doc_id"] for r in de.passages(odd, bench).collect()) == [-5, 5, 6]
    assert licenses.scanned(odd).count() == 0 and licenses.scanned(odd.where("false")).count() == 0


@pytest.mark.parametrize(
    "text, name, edits",
    [
        ("foo. Licensed under the Apache License, Version 2.0. bar", "Apache-2.0", 0),
        ("Licensed under the Apache Licence, Version 2.0.", "Apache-2.0", 1),
        ("Released under the MIT License.", "MIT", 0),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0", 0),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0", 0),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0", 0),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction", "MIT", 0),
    ],
)
def test_notices(text, name, edits):
    assert [(n[0], n[4]) for n in licenses.Templates().notices("prose é before\n\n" + text + "\n\nprose after")] == [(name, edits)]


def test_several_notices_of_a_block():
    found = lambda text: [n[0] for n in licenses.Templates().notices(text)]
    gpl = licenses.NOTICES["GPL-3.0"][1].replace("you can ", "you can\n").replace("General ", "General\n").replace("version ", "version\n")
    assert found("SPDX-License-Identifier: MIT\n" + gpl) == ["MIT", "GPL-3.0"]
    assert found(gpl + "\nSPDX-License-Identifier: MIT\n" + gpl) == ["GPL-3.0", "MIT", "GPL-3.0"]
    names = ["MIT", "ISC", "GPL-2.0", "MPL-2.0", "CC-BY-4.0", "LGPL-3.0", "BSD-2-Clause", "Apache-2.0", "MIT"]
    assert found(" and ".join(licenses.NOTICES[n][-1] for n in names)) == names


def test_ordinary_use_of_the_word_is_no_notice():
    for text in ("The license plate was red.", "He lost his driving licence in May.", "licensed", "x" * 100_000):
        assert licenses.Templates().notices(text) == []


def test_long_texts_are_scanned_whole(table):
    text = "lorem ipsum " * 20_000 + "\nReleased under the MIT License.\n" + "dolor " * 20_000 + "\nLicensed under CC BY-NC 4.0."
    got = licenses.scanned(table([(1, text), (1, text), (2, None)])).collect()
    assert sorted(r["license"] for r in got) == ["CC-BY-NC-4.0", "CC-BY-NC-4.0", "MIT", "MIT"]
    assert all(text[r["start"] : r["end"]].startswith(("Released", "Licensed")) for r in got)


def test_wording_differences():
    edits, first, end, changes = licenses.wording("see the gnu general licence version 3".split(), "the gnu general license version 3".split())
    assert (edits, first, end, changes) == (1, 1, 7, ["license -> licence"])


def plainly(text, templates, most=0.15):
    """Notices of a text without blocks: at every place all templates are compared, and of those that hold the one that shortens its run's surroundings most takes its words."""
    found = [(m.start(), m.end()) for m in licenses._word.finditer(text)]
    own = [text[a:b].lower() for a, b in found]
    out, left = set(), [(0, len(own))]
    while left:
        low, high = left.pop()
        hits = []
        for i, (name, _, t) in enumerate(templates.all):
            edits, first, end, changes = licenses.wording(own[low:high], t)
            if end > first and edits <= most * len(t) and not any(map(licenses.tells, changes)):
                run = text[found[low + first][0] : found[low + end - 1][1]].encode()
                hits.append((len(templates.given[i].compress(run)) - len(templates.plain.compress(run)), name, low + first, low + end))
        if hits:
            _, name, a, b = min(hits)
            out.add((name, found[a][0], found[b - 1][1]))
            left += [(x, y) for x, y in ((low, a), (b, high)) if x < y]
    return out


def test_notices_match_a_plain_comparison(spark):
    """All documents with a cue word: the same licenses at the same places."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("text").rlike(licenses.CUE)).select("doc_id", "text")
    templates = licenses.Templates()
    reach = lambda text, m: text[max(0, m.start() - 1000) : m.end() + 1000]  # noqa: E731 (far from a cue nothing stands that holds)
    want = set()
    for r in docs.collect():
        for m in licenses._cue.finditer(r["text"]):
            low = max(0, m.start() - 1000)
            want |= {(r["doc_id"], n, a + low, b + low) for n, a, b in plainly(reach(r["text"], m), templates) if a + low <= m.start() < b + low}
    got = {(r["doc_id"], r["license"], r["start"], r["end"]) for r in licenses.scanned(docs).collect()}
    assert not got - want, sorted(got - want)[:5]
    assert not want - got, sorted(want - got)[:5]
    assert len(want) > 10


@pytest.mark.parametrize("name", sorted(licenses.NOTICES))
def test_every_wording_is_its_own_license(name):
    templates = licenses.Templates()
    for text in licenses.NOTICES[name]:
        for whole in (text, f"Some prose before it. {text} And some after it, about other things.", text.replace(" ", "\n * ", 3)):
            assert [n[0] for n in templates.notices(whole)] == [name], whole


def test_versions_and_clauses_are_told_apart():
    found = lambda text: [n[0] for n in licenses.Templates().notices(text)]
    two, three = licenses.GNU.format(";", "", ";", "2"), licenses.GNU.format(":", "", ",", "3")
    assert found(two) == ["GPL-2.0"] and found(three) == ["GPL-3.0"] and found(two.replace("version 2", "version 1")) == []
    assert found(two + "\n\n" + three) == ["GPL-2.0", "GPL-3.0"]
    assert found(three.replace("GNU", "GNU Lesser")) == ["LGPL-3.0"] and found(three.replace("GNU", "GNU Affero")) == ["AGPL-3.0"]
    assert found(f"{licenses.BSD[0]}:\n\n {licenses.BSD[1]}") == ["BSD-2-Clause"]
    assert found(f"{licenses.BSD[0]}:\n\n {licenses.BSD[1]}\n\n {licenses.BSD[2]}") == ["BSD-3-Clause"]
    assert found(licenses.BSD[0]) == ["BSD"]
    for form in ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "AGPL-3.0-only", "LGPL-2.1-or-later", "BSD-4-Clause", "GPL-2.0+"):
        assert found(f"// SPDX-License-Identifier: {form}") == [form.replace("-only", "").replace("-or-later", "").replace("+", "")]


def test_the_ranking_decides():
    """The short Apache notice stands in the long one without a difference; the long one, with a slip in it, saves more and takes all its words."""
    text = licenses.NOTICES["Apache-2.0"][1].replace("obtain a copy", "get a copy")
    templates = licenses.Templates()
    (name, start, end, _, edits, _), = templates.notices(text)
    assert (name, start, end, edits) == ("Apache-2.0", 0, len(text), 1)
    ranked = licenses.Templates.ranked
    try:
        licenses.Templates.ranked = lambda self, block: [(1, 0.5, i) for i in range(len(self.all))]  # no compression: in the list's order
        assert [(n[1], n[2]) for n in licenses.Templates().notices(text)][0] != (0, len(text))
    finally:
        licenses.Templates.ranked = ranked


def test_what_saves_nothing_is_never_confirmed():
    rng = random.Random(3)
    templates = licenses.Templates()
    for _ in range(150):
        name, text, words = rng.choice(templates.all)
        own = text.split()
        for _ in range(rng.randint(0, max(1, len(own) // 7))):
            own[rng.randrange(len(own))] = rng.choice(["x", "the", "word", "Y."])
        block = " ".join(rng.choices(["lorem", "ipsum", "dolor", "amet"], k=rng.randint(0, 8))) + " " + " ".join(own)
        run, there = licenses.words(block), Counter(licenses.words(block))
        ranked = {i for _, _, i in templates.ranked(block)}
        assert all(i in ranked for i in range(len(templates.all)) if templates.confirmed(i, run, there, 0.15))


def test_notices_beside_clashing_columns(table):
    docs = table([(1, "Released under the MIT License."), (None, "Released under the MIT License."), (2, None)])
    odd = docs.withColumnRenamed("lang", "license").withColumnRenamed("source", "start").withColumnRenamed("n_chars", "changes")
    assert sorted(str(r["doc_id"]) + r["license"] for r in licenses.scanned(odd).collect()) == ["1MIT", "NoneMIT"]
