"""Windows at the same place of the corpus: repeated rows, and rows that count as one document."""

from __future__ import annotations

import random

from castlens.llm import substring
from castlens.llm.substring import dedup_substrings
from tests.llm.test_lines_and_windows import check_windows


def own(n, name):
    return [f"{name}{i}" for i in range(n)]


def frame(spark, data, parts):
    return spark.createDataFrame(data, "doc_id long, text string").repartition(parts)


def test_repeated_rows_stay_whole(spark):
    text = " ".join(own(50, "a"))
    data = [(1, text), (1, text), (None, " ".join(own(40, "b"))), (None, " ".join(own(40, "b"))), (None, " ".join(own(40, "b")))]
    for parts in (1, 4):
        got = dedup_substrings(frame(spark, data, parts)).collect()
        assert [r.n_removed for r in got] == [0] * 5
        check_windows(frame(spark, [*data, (7, text), (7, text), (0, " ".join(own(30, "c") + own(25, "a")))], parts))


def test_rows_of_one_id_share_places(spark):
    """A passage at the same word of some texts, and earlier or later in others, all of one id or of none."""
    pick = random.Random(9)
    passage = own(45, "p")
    data = []
    for k in range(60):
        start = pick.choice([0, 3, 3, 3, 8, 25])
        low = pick.randint(0, 15)
        w = [f"x{pick.randint(0, 2)}" for _ in range(start)] + passage[low:pick.randint(low + 20, 45)] + own(pick.randint(0, 30), f"t{k}_")
        data += [(pick.choice([None, None, 4, k]), " ".join(w))] * pick.choice([1, 1, 2])
    for parts in (1, 5):
        check_windows(frame(spark, data, parts))


def test_shards_of_split_anchors_keep_equal_places(spark, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_SEGMENTS", 8)
    pick = random.Random(2)
    passage = own(30, "p")
    data = []
    for k in range(120):
        text = " ".join([f"x{pick.randint(0, 3)}" for _ in range(12)] + passage + [f"y{pick.randint(0, 3)}" for _ in range(12)])
        data += [(k // 5, text)] * (1 + k % 2)
    check_windows(frame(spark, data, 2))


def test_many_rows_without_an_id_keep_their_own_words(spark):
    """Spans of one text never reach another of the same id, however many there are."""
    first = " ".join(own(30, "q"))
    data = [(1, first), (None, first)] + [(None, " ".join(own(30, f"u{k}_"))) for k in range(1500)]
    got = dedup_substrings(frame(spark, data, 3))
    assert sorted((r.doc_id or 0, r.n_removed) for r in got.where("n_removed > 0").collect()) == [(0, 30)]
    check_windows(frame(spark, data, 3))
