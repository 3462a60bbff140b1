"""Parsing, labels, words, distinct-line lookups and synthetic lines."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from omenlog.functions import normalise as nz
from omenlog.functions import scoring
from omenlog.functions import time as tf
from omenlog.functions import words as wd
from omenlog.operators import dedup, split, surprise, synthetic, temporal
from omenlog.operators.order import Order
from omenlog.schema import split_lines
from omenlog.sources import text


def apply(spark, build, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "line_id long, raw string")
    rows = df.select("line_id", build(F.col("raw")).alias("out")).collect()
    return [r.out for r in sorted(rows, key=lambda r: r.line_id)]


def test_generic_profile(spark):
    lines = [
        "  Received blk_-123 from 10.0.0.1:50010 size 67108864!  ",
        "Étage ٣٤ naïve",  # Arabic-Indic digits and accents
        "...", "été",
    ]
    assert apply(spark, nz.normalise, lines) == [
        "received BLK from IP size NUM", "etage NUM naive", "", "ete"
    ]


def test_bgl_profile(spark):
    line = "1200000021 2007.01.02 A17-B3-C2-D:E05-F9 SYS BOOT NOTE memory controller checksum mismatch repaired"
    out = apply(spark, lambda c: nz.normalise(c, "bgl"), [line, "err at 0xfe12ab code=77"])
    assert out[0] == "iar num time server sys boot note memory controller checksum mismatch repaired"
    assert out[1] == "err at memory code num"
    dropped = apply(spark, lambda c: nz.normalise(c, replace(nz.PROFILES["bgl"], skip=3)), ["a b c d e"])
    assert dropped == ["d e"]


def test_masks_match_python_patterns(spark):
    """The guarded, ASCII-specialised chain against Python's re on the same patterns."""
    lines = [
        "- 1131566461 2005.11.09 dn228 Nov 9 12:01:01 dn228/dn228 crond(pam_unix)[2915]: session for user root@host-1",
        "node-12 a.b_c@x.y-z [42] deadbeef00 「x」 naïve-é 12:00:00 /var/log/x.1 key=v;",
        "blk_9 at 10.1.2.3:80 ts 2005-06-03-15.42.50.363779 path /bgl/BlueLight/ppc/x12 R02-M1:J0 end",
    ]
    for masks in (nz.THUNDERBIRD_MASKS, nz.BGL_MASKS, nz.HDFS_MASKS):
        want = []
        for line in lines:
            for pattern, name, _ in masks:
                line = re.sub(pattern, name, line)
            want.append(line)
        assert apply(spark, lambda c: nz.mask(c, masks), lines) == want


def test_forward_look_aheads_match_the_same_text():
    """"a digit and a letter further on" may be searched forwards instead of backwards."""
    # Fixed value: the mask as it is defined, the measure of equality.
    slow = r"\S+(?=.*[0-9])(?=.*[a-zA-Z])(?=[:]+)\S+"
    quick = next(p for p, name, needs in nz.BGL_MASKS if needs == ":")
    lines = ["R02-M1:J12 x", "a:b c:1 d:", "no digits: here", "9:9 9:x", "::a1 b", "x:1", "é:1 z", "a:: 5", "1:2 q:w 3"]
    for line in lines:
        assert re.sub(slow, "#", line) == re.sub(quick, "#", line)


def test_profile_names_are_checked(spark):
    with pytest.raises(ValueError):
        nz.normalise(F.col("raw"), "unknown")


def test_fold_accents_is_exact_beyond_latin(spark):
    assert apply(spark, nz.fold_accents, ["한é", "Å", "plain"]) == ["한e", "A", "plain"]


def test_word_and_marker_labels(spark):
    words = ["1", "anomaly", "Anomaly", "abnormal", "0", "normal", "Normal", "- x", "R02", " "]
    assert apply(spark, nz.word_label, words) == [1, 1, 1, 1, 0, 0, 0, 0, 1, None]
    assert apply(spark, nz.marker_label, ["- ok", "APPREAD bad", ""]) == [0, 1, 1]


def test_block_ids(spark):
    line = "blk_-1 then blk_2 and blk_-1 again"
    assert apply(spark, nz.block_id, [line, "none"]) == ["blk_-1", None]
    assert apply(spark, nz.block_ids, [line]) == [["blk_-1", "blk_2"]]


def test_event_times(spark):
    def seconds(dialect, **kw):
        return lambda c: F.unix_seconds(tf.event_time(c, dialect, **kw))

    assert apply(spark, seconds("bgl"), ["1117838570 2005.06.03 R02", "- 1117838570 x", "TAG 1117838570 x", "none"]) == [
        1117838570, 1117838570, 1117838570, None
    ]
    assert apply(spark, seconds("thunderbird"), ["- 1129903038 0 m", "ECC 1129903038 0 m"]) == [1129903038, None]
    assert apply(spark, seconds("thunderbird", any_tag=True), ["ECC 1129903038 0 m"]) == [1129903038]
    assert apply(spark, seconds("hdfs"), ["081109 203518 148 INFO", "081309 203518 1", "081109 203560 1"]) == [
        1226262918, None, None
    ]


def test_log_delta_clamps(spark):
    df = spark.createDataFrame([(-100.0,), (0.0,), (1000.0,)], "x double")
    got = [r[0] for r in df.select(tf.log_delta(F.col("x"))).collect()]
    assert got[0] == got[1] == 0.0 and got[2] == pytest.approx(6.90875, abs=1e-4)


def test_delta_ms_skips_unknown_times_and_clamps(spark):
    rows = [(0, None), (1, 1_000_000), (2, None), (3, 2_500_000), (4, 2_000_000)]
    df = spark.createDataFrame(rows, "line_id long, us long")
    got = [r.delta_ms for r in temporal.delta_ms(df).orderBy("line_id").collect()]
    assert got == [0.0, 0.0, 0.0, 1500.0, 0.0]


def test_constant_feature_scales_to_zero(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    for method in ("minmax", "zscore"):
        assert [r.x for r in temporal.normalise(df, ["x"], method)[0].collect()] == [0.0, 0.0]


def test_pooling_of_an_empty_line(spark):
    df = spark.createDataFrame([([],)], "a array<double>")
    row = df.select(*[scoring.pool(F.col("a"), m).alias(m) for m in scoring.POOLING]).first()
    assert set(row) == {0.0}


def test_packing(spark):
    df = spark.createDataFrame([([3, 3, 3, 9, 1, 1, 20, 1],), ([],)], "n array<int>")
    out = [r[0] for r in df.select(F.pandas_udf(wd.pack, "array<int>")(F.col("n"), F.lit(8))).collect()]
    assert out == [[0, 0, 1, 2, 3, 3, 4, 5], []]


def test_scores_reach_every_copy_of_a_hot_text(spark):
    rows = [(i, "hot" if i % 3 else f"t{i % 7}") for i in range(300)]
    df = spark.createDataFrame(rows, "line_id long, norm string")
    out = dedup.score_once(df, lambda once: once.withColumn("n", F.length("norm"))).collect()
    assert sorted((r.line_id, r.norm, r.n) for r in out) == [(i, t, len(t)) for i, t in rows]


def test_blocks_are_ordered_rows(spark):
    rows = [(i, None if i == 7 else "a" if i % 4 else "b", f" l{i} ") for i in range(20)]
    df = spark.createDataFrame(rows, "line_id long, block string, raw string").repartition(3)
    got = sorted((r.block or "", r.pos, r.line, r.first_seen, r.n_lines) for r in split.group_blocks(df, "block").collect())
    want = []
    for name in ("a", "b", None):
        mine = [(i, t) for i, b, t in rows if b == name]
        want += [(name or "", k, t.strip(), mine[0][0], len(mine)) for k, (i, t) in enumerate(mine)]
    assert got == sorted(want)


def test_early_anomalies_can_be_left_out(spark):
    rows = [(i, 1 if i == 1 else 0) for i in range(10)]
    df = spark.createDataFrame(rows, "line_id long, label int")
    roles = {r.line_id: r.role for r in split.line_split(df, 0.5, include_early_anomalies=False).collect()}
    assert roles[1] is None and roles[0] == "train" and roles[9] == "test"


def test_read_lines_drops_invalid_bytes_and_numbers_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"first\n\xff\xfesecond \xc3\xa9\n\nfourth\n")
    (tmp_path / "b.log").write_bytes(b"only\n")
    rows = text.read_lines(spark, str(tmp_path)).collect()
    got = sorted((r.file[-5:], r.line_no, r.raw) for r in rows)
    assert got == [("a.log", 0, "first"), ("a.log", 1, "second é"), ("a.log", 2, ""), ("a.log", 3, "fourth"),
                   ("b.log", 0, "only")]


def test_read_lines_keeps_written_replacement_characters(spark, tmp_path):
    (tmp_path / "c.log").write_bytes("a\ufffdb \ufdd0a \ufdd0b\n".encode() + b"x\xc3\xef\xbf\xbdy\xf0\x9f\n")
    got = sorted((r.line_no, r.raw) for r in text.read_lines(spark, str(tmp_path)).collect())
    assert got == [(0, "a\ufffdb \ufdd0a \ufdd0b"), (1, "x\ufffdy")]


def test_line_ids_never_collide(spark):
    fine = split_lines(spark.createDataFrame([(1, "a\nb"), (2, "c"), (-1, "d"), ((1 << 32) - 1, "e")], "i long, t string"), "i", "t")
    assert len({r.line_id for r in fine.collect()}) == 5
    wide = split_lines(spark.createDataFrame([(1 + (1 << 33), "a")], "i long, t string"), "i", "t")
    with pytest.raises(Exception, match="33 bits"):
        wide.collect()


def test_label_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text("BlockId,Label\nblk_1, anomaly \nblk_2,Normal\n")
    got = {r.block: r.label for r in text.read_block_labels(spark, str(tmp_path / "l.csv")).collect()}
    assert got == {"blk_1": 1, "blk_2": 0}
    (tmp_path / "l.txt").write_text("0\n\nabnormal\n- x\n")
    rows = text.read_line_labels(spark, str(tmp_path / "l.txt")).collect()
    assert sorted((r.line_no, r.label) for r in rows) == [(0, 0), (1, 1), (2, 0)]


def test_surprise_of_known_and_new_words(spark):
    df = spark.createDataFrame([("a b c",)] * 8 + [("a d c",)] * 2, "norm string")
    model = surprise.train(df)
    lines = spark.createDataFrame([("a b c",), ("a x c",), ("y z",)], "norm string")
    rows = {(r.norm, r.pos): r for r in surprise.word_scores(model, lines, key="norm").collect()}
    assert len(rows) == 8
    import math

    room = 0.1 * 5
    assert rows[("a b c", 1)].err == pytest.approx(-math.log(8.1 / (10 + room)))
    assert rows[("a x c", 1)].err == pytest.approx(-math.log(0.1 / (10 + room)))
    assert rows[("a x c", 1)].prob == pytest.approx(1 - 8.1 / (10 + room))
    # ("<s>", "z") was never seen together: the left neighbour decides
    assert rows[("y z", 0)].err == pytest.approx(-math.log(0.1 / (10 + room)))
    # neither neighbour was seen: word frequencies decide
    assert rows[("y z", 1)].prob == pytest.approx(1 - 10.1 / (30 + room))


def test_synthetic_lines(spark):
    rows = [(i, ["[CLS]", *[f"w{j}" for j in range(i % 6 + 1)], "[SEP]"], float(i)) for i in range(60)]
    lines = spark.createDataFrame(rows, "line_id long, tokens array<string>, delta double")
    vocabulary = spark.createDataFrame([(f"v{i}",) for i in range(9)] + [("[PAD]",)], "word string")
    out = synthetic.augment(lines, vocabulary, ratio=0.5, seed=3)
    again = synthetic.augment(lines.repartition(7), vocabulary, ratio=0.5, seed=3)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))
    source = {r[0]: r for r in rows}
    made = out.filter("label = 1").collect()
    assert len(made) == 30 and {r.method for r in made} == set(synthetic.METHODS)
    for r in made:
        before = source[r.line_id][1]
        if r.method == "replace":
            changed = [(a, b) for a, b in zip(before, r.tokens) if a != b]
            assert len(before) == len(r.tokens) and 1 <= len(changed) <= 3
            assert all(b.startswith("v") and a not in synthetic.SPECIAL for a, b in changed)
        elif r.method == "shuffle":
            assert sorted(before) == sorted(r.tokens) and r.tokens[0] == "[CLS]" and r.tokens[-1] == "[SEP]"
        elif r.method == "temporal":
            assert r.tokens == before and (r.delta == 0 or 10 <= r.delta / source[r.line_id][2] <= 100)
    with pytest.raises(ValueError):
        synthetic.augment(lines, vocabulary, methods=["rare_event"])


def test_rare_words_and_template_mixes(spark):
    lines = spark.createDataFrame([(i, ["a", "b"]) for i in range(5)], "line_id long, tokens array<string>")
    rare = spark.createDataFrame([("r1",), ("r2",)], "word string")
    for r in synthetic.insert_rare(lines, rare, insertions=2).collect():
        assert len(r.tokens) == 4 and [t for t in r.tokens if t in "ab"] == ["a", "b"]
    found = spark.createDataFrame([("a b c d",), ("e f",)], "norm string")
    mixes = {tuple(r.tokens) for r in synthetic.mix_templates(found, 40).collect()}
    assert mixes <= {("a", "b"), ("e", "b", "c", "d")} and mixes


def test_row_roll_up_drops_the_partial_tail(spark):
    df = spark.createDataFrame([(i, i, float(i)) for i in range(10)], "line_id long, us long, score double")
    out = temporal.roll_up_rows(df, 4, order=Order(ranges=3)).orderBy("step").collect()
    assert [(r.step, r.mean) for r in out] == [(0, 1.5), (1, 5.5)]


def test_written_reports_are_read_back(spark, tmp_path):
    from omenlog.operators import report

    for model, f1 in (("one", 0.9), ("two", 0.8)):
        folder = tmp_path / "runs" / model / "results"
        folder.mkdir(parents=True)
        (folder / "x_k5_report.txt").write_text(
            f"AUROC: 0.990000\nbest_F1: {f1:.6f}\nbest_threshold: 7.64\n\nconfusion_matrix:\n[[5 1]\n [0 4]]\n\n"
            "              precision    recall  f1-score   support\n\n"
            "           0     1.0000    0.8333    0.9091         6\n           1     0.8000    1.0000    0.8889         4\n"
        )
    rows = report.read_reports(spark, str(tmp_path / "runs" / "*" / "results")).orderBy("model").collect()
    assert [(r.model, r.file, r.best_F1, r.Precision, r.Recall, r.F1_score) for r in rows] == [
        ("one", "x_k5", 0.9, 0.8, 1.0, 0.8889), ("two", "x_k5", 0.8, 0.8, 1.0, 0.8889)
    ]
    assert rows[0].best_threshold == 7.64
