"""Every stage of the pipeline on odd rows and on an empty table."""

import pytest

import corpus_pipeline as P

DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, log_ppl double, class_id long, size long, best string"
PROSE = " ".join(f"{a} {b} walked home" for a in ("the old man", "a young cat", "her best friend", "that tall king") for b in ("slowly", "gladly", "in rain", "by night"))

OTHER, THIRD = " ".join(reversed(PROSE.split())), " ".join(sorted(PROSE.split()))


def rows():
    texts = [(1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (None, " \n\t", None, "b"), (5, "password = hunter2hunter2 " + OTHER, "fr", None), (6, "x" * 30_000 + " " + THIRD, "de", "c")]
    return [(*t, None if t[1] is None else len(t[1]), "clash", 1.0, 7, 9, "clash") for t in texts]


@pytest.mark.parametrize("k", range(len(P.STAGES)))
def test_a_stage_on_odd_rows_and_on_none(spark, tmp_path, k):
    docs = spark.createDataFrame(rows(), DOC).repartition(3)
    stage = P.STAGES[k][1]
    found = stage(spark, docs, "")
    got = found.collect()
    assert stage(spark, docs.limit(0), "").collect() == []
    if k < len(P.STAGES) - 1:
        assert found.columns == P.COLUMNS
    ids = sorted((r["doc_id"] for r in got), key=str)
    if k == 0:  # texts without words go, and nothing that isn't there comes
        assert not {3, 4, None} & set(ids) and set(ids) <= {1, 2, 5, 6} and ids.count(2) in (0, 2)
    elif k == 1:  # one of each class; texts without a word are alone
        assert ids == [1, 3, 4, 5, 6, None]
    elif k == 2:
        assert len(got) == len(rows())
        by = {r["doc_id"]: r for r in got}
        assert "hunter2" not in by[5]["text"] and by[5]["n_chars"] == len(by[5]["text"]) and by[3]["text"] is None and by[3]["n_chars"] is None and by[1]["text"] == PROSE
    elif k == 3:
        assert all(ids.count(i) == 1 for i in (3, 4, None)) and max(ids.count(i) for i in (1, 5, 6)) <= 2 and ids.count(2) <= 4
    else:
        by = {r["doc_id"]: r for r in got}
        assert len(got) == len(rows()) and by[3]["ids"] is None and by[4]["ids"] == [] and by[4]["other_ids"] is None and by[1]["n_pieces"] == len(by[1]["ids"]) > 20
