"""License labels by brute force, telling pairs whatever the order of documents, empty tables, null ids."""

import numpy as np
import pytest

from tallyline.llm import licenses, mixing, packing, simhash, substrings, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("text, labels", [
    ("Licensed under the GNU General Public License", "gpl"),
    ("Licensed under the GNU Lesser General Public License", "gpl,lgpl"),
    ("Licensed under the GNU Affero General Public License", "agpl,gpl"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("Licensed under CC BY 4.0.", "cc-by"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("He was licensed under a treaty signed by 4 parties with 0 votes against", ""),
    ("The license under the table was released by some of the MIT group", ""),
    ("Licensed under the Eclipse Public License, Version 2.0", ""),
    ("This work is licensed under the European Union Public License, version 3", ""),
    ("Released under the MIT License. Licensed under the BSD 3-Clause License", "bsd,mit"),
])
def test_labels_of_notices_and_of_prose(text, labels):
    index = licenses.Index(licenses.TEMPLATES, {})
    for whole in (text, "before\n" + text + "\nafter", text.replace(" ", "\n"), "prose " * 100 + text + " prose" * 100):
        assert licenses.scan(whole.encode(), index)[5] == labels


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = 0
        for j, y in enumerate(b):
            above, row[j + 1] = row[j + 1], above + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_labels_by_brute_force():
    templates = (("x", "a b c d e"), ("x long", "a b c d e f g h i j"), ("y", "c d e f g"), ("y", "c d e f g"), ("z", "e d c b a"))
    index, rng = licenses.Index(templates, {}, names={"y": ("c d",)}), np.random.default_rng(2)
    for _ in range(400):
        text = [str(x) for x in rng.choice(list("abcdefghij") + ["-"] * 3, rng.integers(0, 24))]
        block = [w for w in text if w != "-"]
        full = {}
        for k, (label, t) in enumerate(templates):
            t = t.split()
            common = set(t) & set(block)
            near = any(longest_common(t, block[s : s + 2 * len(t)]) >= 0.8 * len(t) for s in range(len(block)) if block[s] in t)
            named = label != "y" or " c d " in f" {' '.join(block)} "
            if len(common) >= 0.8 * len(t) and near and named:
                full[k] = common
        want = {templates[k][0] for k in full if not any(full[k] < full[o] for o in full)}
        words = [w.encode() for w in block]
        assert index.named(words, index.matches(words)) == want


def exclusive(n, first, seed=0):
    rng, rows, labels = np.random.default_rng(seed), [], []
    for k in range(n):
        a, b = rng.random(2) < 0.5
        words = rng.choice(np.arange(100, 400), 20, replace=False).tolist()
        label = int(rng.random() < 0.5)
        if k >= first:
            words += [5000] * int(a) + [6000] * int(b)
            label = int(a != b)
        rows.append(np.unique(words).astype(np.int32))
        labels.append(label)
    return rows, np.array(labels)


@pytest.mark.parametrize("shuffled", [False, True])
def test_pairs_are_found_in_any_order_of_the_rows(shuffled):
    rows, labels = exclusive(8000, 4200)
    order = np.random.default_rng(1).permutation(8000) if shuffled else np.arange(8000)
    machine = toxicity.learn([rows[k] for k in order], labels[order])
    assert machine.known.tolist() == [5000, 6000]
    assert ((machine.scores(rows[4200:]) >= 0.5) == labels[4200:]).all()


def test_pairs_of_long_texts_come_in_steps(monkeypatch):
    rows, labels = exclusive(400, 0)
    want = toxicity.telling_pairs(rows, labels, np.zeros(0, np.int32))
    monkeypatch.setattr(toxicity, "PAIRS_HELD", 7)
    assert toxicity.telling_pairs(rows, labels, np.zeros(0, np.int32)).tolist() == want.tolist() == [5000, 6000]
    long = [np.arange(20_000, dtype=np.int32)] * 5 + rows
    assert toxicity.telling_pairs(long, np.append(np.ones(5), labels), np.zeros(0, np.int32), 3, 64).size == 0


def test_empty_tables_and_null_ids_in_the_stages(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, toxic int")
    for stage in (lambda d: toxicity.drop_toxic(d, labels), simhash.drop_near_duplicates, substrings.drop_repeats, mixing.mix, packing.pack, licenses.license_scan):
        assert stage(none).count() == 0
    odd = spark.createDataFrame([(None, "some words", "en", "s", 1), (None, None, None, None, None)], DOCS)
    assert sorted(map(tuple, toxicity.drop_toxic(odd, labels, least=0.6).collect()), key=str) == sorted(map(tuple, odd.collect()), key=str)
