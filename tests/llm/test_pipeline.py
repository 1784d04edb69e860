"""The pipeline and its stages against a brute-force version."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from corpusveil.llm import mixing  # noqa: E402
from tests.llm.test_contracts import SPACE, W, brute_fingerprint, classes  # noqa: E402


def corpus():
    random.seed(7)
    word = lambda: "".join(random.choice("abcdefghijklmnop") for _ in range(random.randint(2, 8)))
    rows = []
    for i in range(120):
        rows.append((i, " ".join(word() for _ in range(random.choice([10, 40, 120]))) + ".", random.choice(["s0", "s0", "s1", "s2", None])))
    for i in range(120, 140):  # exact copies but for white space
        rows.append((i, rows[i - 120][1].replace(" ", "  "), "s0"))
    for i in range(140, 160):  # near copies
        rows.append((i, rows[i - 140][1].replace(".", "!"), "s1"))
    return rows + [(200, None, "s1"), (201, "", "s2"), (202, "nav | bar | one | two | three | four | five | six | seven | eight | nine | ten", "s0"), (203, "short one", None), (205, "w " * 12 + " ".join(f"unique{i}" for i in range(40)) + ".\nAll rights reserved.", "s2"), (17, "another text of a repeated id " + " ".join(f"other{i}" for i in range(40)) + ".", "s1"), (204, "the same nine words over and over again now " * 20, "s1")]


def test_run(spark, tmp_path):
    import public_tokenizers as P
    import tiktoken

    from corpusveil.llm.bpe import load_ranks

    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), "x") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, size string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()

    def good(t):
        words = W.findall(t or "")
        grams = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        again = {j for k in range(len(words) - 7) if grams[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
        return len(words) >= 20 and 100 * len(again) <= 30 * len(words) and " | " not in (t or "")

    left = [(i, t.removesuffix("\nAll rights reserved."), s) for i, t, s in rows if good(t)]
    groups = defaultdict(list)
    for i, t, s in left:
        groups[SPACE.sub("", t)].append((-len(t), i, t, s))
    left = sorted((i, t, s) for _, i, t, s in map(min, groups.values()))
    fps = [brute_fingerprint(t) for _, t, _ in left]
    roots = classes(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    left = [x for k, x in enumerate(left) if roots[k] == k]  # sorted by id, so a root has the smallest
    frame = spark.createDataFrame(left, "doc_id long, text string, source string")
    copies = Counter()
    for r in mixing.curriculum_order(frame).collect():
        copies[r.doc_id, r.text] += 1
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter()
    for i, t, _ in left:
        ids = np.array(coder.encode_ordinary(t), "<u4")
        want[(i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] += copies[i, t]
    assert Counter(tuple(r)[:4] for r in got) == +want and 20 < len(left) < 130 and 205 in {r.doc_id for r in got}
    # The order of files and rows is the training order.
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.order_part, r.order_row))]
    assert order == [r.doc_id for r in mixing.curriculum_order(frame).collect()]


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    clash = "doc_id long, text string, lang string, source string, n_chars long, size string, position int, fp int, kept int, _len int, first string"
    docs = spark.createDataFrame([(i, "some words that are fine to keep, twenty of them or a few more than that, so here they are now, all " + str(i), None, None, None, None, 1, 2, 3, 4, "5") for i in (1, 1, 2, None)], clash)
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs, str(tmp_path)).count() > 0, name
        assert stage(spark, docs.filter("false"), str(tmp_path)).count() == 0, name
    assert pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 4
    assert pipeline.STAGES[-1][1](spark, docs.filter("false"), str(tmp_path)).count() == 0
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_dedup", "mixing", "byte_bpe"] and pipeline.ORACLE_SQL is None
