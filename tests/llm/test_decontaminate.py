import hashlib
import re

import pytest
from llm_text import text_of

from tabspark.llm import decontaminate


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    names |= {str(x) for x in own if x is not None}
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


ITEMS = [(0, text_of(1, 40)), (1, text_of(2, 12)), (2, "Three Words only"), (3, None), (4, "..."), (10, text_of(1, 40)), (11, "the the the the the the the the the the the"), (None, text_of(9, 15)), (0, text_of(1, 40))]


def corpus():
    docs = [(k, text_of(50 + k, 20 * k)) for k in range(12)]
    docs += [(20, "x " * 9 + text_of(1, 40).upper() + " tail"), (21, " ".join(text_of(1, 40).split()[5:15])), (22, " ".join(text_of(1, 40).split()[5:14]))]
    docs += [(23, "lead " + text_of(2, 12).replace(" ", ", ") + "; " + text_of(2, 12)), (24, "three words ONLY three words only"), (25, None), (26, ""), (27, "!? ."), (28, "the " * 30000)]
    docs += [(29, text_of(9, 15)), (30, "the " * 9), (31, text_of(1, 40) + " " + text_of(1, 40))]
    return docs + [(100 + k, "common lead " + text_of(1, 40) + f" end{k}") for k in range(200)]


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WINDOWS, 20])
def test_contamination_against_plain(rows, block, monkeypatch):
    docs = corpus()
    table = rows("doc_id long, text string, id int, hits int", *((k, t, 0, 0) for k, t in docs))
    monkeypatch.setattr(decontaminate, "CHUNK", 500)
    found = decontaminate.search(decontaminate.build_index(table), decontaminate.item_windows(rows("item_id long, text string", *ITEMS)), block_windows=block)
    want = plain(docs, ITEMS)
    got = {r.id: r for r in found.collect()}
    assert set(got) == set(want)
    for k, r in got.items():
        covered = {p for h in r.hits for p in range(h["at"], h["at"] + h["words"])}
        assert (r.n_words, len(covered), len({h["item"] for h in r.hits} - {None})) == want[k][:3]


def test_digest_columns_and_filter(rows):
    docs = corpus()
    table = rows("doc_id long, text string, n_words int, item string", *((k, t, 0, "") for k, t in docs))
    items = rows("item_id long, text string, window int", *((k, t, 1) for k, t in ITEMS))
    want = plain(docs, ITEMS)
    assert {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination(table, items).collect()} == want
    kept = decontaminate.drop_contaminated(table, items)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {k for k, v in want.items() if not v[4]}


def test_empty_tables_and_repeated_rows(rows):
    items = rows("item_id long, text string", *ITEMS)
    assert decontaminate.contamination(rows("doc_id long, text string"), items).count() == 0
    twice = rows("doc_id long, text string", (1, text_of(2, 12)), (1, text_of(2, 12)))
    assert [r.n_hit for r in decontaminate.contamination(twice, items).collect()] == [12, 12]
    none = decontaminate.contamination(twice, rows("item_id long, text string")).collect()
    assert [(r.n_hit, r.n_items, r.contaminated) for r in none] == [(0, 0, False)] * 2


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WINDOWS, 1])
def test_rows_that_share_an_id_stay_apart_in_blocks(rows, block):
    items = rows("item_id long, text string", (1, text_of(2, 12)), (2, text_of(3, 12)))
    filler = text_of(70, 12)
    docs = rows("doc_id long, text string", (1, text_of(2, 12)), (1, text_of(2, 12)), (1, text_of(3, 12)), (1, filler), (None, text_of(3, 12)), (None, filler))
    found = decontaminate.search(decontaminate.build_index(docs), decontaminate.item_windows(items), block_windows=block).collect()
    got = sorted((r.id or 0, len(r.hits), sorted({h["item"] for h in r.hits})) for r in found)
    assert got == [(0, 0, []), (0, 3, ["2"]), (1, 0, []), (1, 3, ["1"]), (1, 3, ["1"]), (1, 3, ["2"])]


def test_proximity(rows):
    docs = [(1, "red a b green c d blue"), (2, "red " + "x " * 30 + "green blue"), (3, "red green"), (4, "blue z red z green"), (5, "red"), (6, "green blue")]
    index = decontaminate.build_index(rows("doc_id long, text string", *docs))
    found = decontaminate.search(index, decontaminate.item_windows(rows("item_id long, text string", (7, "Red green blue"))), within=6)
    assert {r.id for r in found.collect() if r.hits} == {1, 4}


def test_windows_that_many_items_share_are_hit_once(rows, spark):
    passage = text_of(7, 30)
    items = [(k, passage + " " + text_of(1000 + k, 3)) for k in range(300)] + [(900, text_of(7, 12))]
    docs = [(k, text_of(20 + k, 5) + " " + passage) for k in range(5)] + [(9, text_of(50, 30))]
    table, tests = rows("doc_id long, text string", *docs), rows("item_id long, text string", *items)
    own, sets = decontaminate.window_sets(decontaminate.item_windows(tests))
    found = decontaminate.matches(decontaminate.build_index(table), own).collect()
    assert sum(len(r.hits) for r in found) == 5 * 21  # places, whatever the number of items
    assert sets.count() < 300 + 301 + 300 * 4
    assert {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination(table, tests).collect()} == plain(docs, items)
