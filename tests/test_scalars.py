"""Hand-computed numbers for the scalar functions."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mnemos.config import EngineConfig
from mnemos.functions import scoring as S
from mnemos.functions import text as T
from mnemos.functions import vector as X

NOW = datetime(2026, 7, 29)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def at(days):
    return F.lit(NOW - timedelta(days=days)).cast("timestamp")


def now():
    return F.lit(NOW).cast("timestamp")


@pytest.mark.parametrize(("days", "want"), [(0, 1.0), (209, 2.8948273e-05), (-3, 1.0)])
def test_effective_score(spark, days, want):
    assert value(spark, S.effective_score(F.lit(1.0), F.lit(1.0), at(days), now(), 0.05)) == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize(("base", "sim", "lex", "want"), [(0.7, 0.5, 0.5, 0.4025), (1.0, 0.2, 0.0, 0.269)])
def test_blend(spark, base, sim, lex, want):
    assert value(spark, S.blend(F.lit(base), S.relevance(F.lit(sim), F.lit(lex), 0.7))) == pytest.approx(want)


@pytest.mark.parametrize(("score", "lex", "want"), [(0.35, 0.0, False), (0.40, 0.0, True), (0.30, 0.5, True), (0.20, 0.5, False)])
def test_gates(spark, score, lex, want):
    assert value(spark, S.passes(F.lit(score), F.lit(lex), 0.25, 0.38)) is want


@pytest.mark.parametrize(
    ("content", "query", "want"),
    [("数据库使用 PostgreSQL", "数据库用什么", 0.4), ("老大喜欢吃螺蛳粉加炸蛋", "数据库用什么", 0.0), ("FastAPI memory kernel", "FastAPI kernel speed", 2 / 3), ("x", "", 0.0), ("a　b", "A　B", 1.0)],
)
def test_lexical_similarity(spark, content, query, want):
    assert value(spark, T.lexical_similarity(F.lit(content), T.tokens(F.lit(query)))) == pytest.approx(want)


def test_overlap_and_hits(spark):
    from mnemos.operators.consolidate import keys

    assert value(spark, T.overlap(keys(F.lit("red small ring")), keys(F.lit("red small widget")))) == pytest.approx(0.5)
    assert value(spark, T.overlap(keys(F.lit("")), keys(F.lit("red")))) == 0.0
    assert value(spark, T.query_keys(F.lit("改用 Go，改用 x"))) == ["改用", "go"]
    assert value(spark, T.near_duplicate(F.lit(" same\n"), F.lit("same"))) is True


@pytest.mark.parametrize(
    ("content", "kind", "want"),
    [("项目使用 FastAPI 和 SQLite 作为存储", "fact", 0.85), ("哈哈你好天气不错", "episode", 0.05), ("早上好呀", "episode", 0.20)],
)
def test_importance(spark, content, kind, want):
    assert value(spark, S.importance(F.lit(content), F.lit(kind), F.lit(False))) == pytest.approx(want)
    assert value(spark, S.importance(F.lit(content), F.lit(kind), F.lit(True))) == 1.0


@pytest.mark.parametrize(("imp", "days", "count", "pinned", "want"), [(0.9, 0, 0, False, 0.675), (0.9, 30, 5, False, 0.5277436), (1.0, 0, 20, True, 1.35), (0.2, 365, 0, False, 0.07)])
def test_reweight(spark, imp, days, count, pinned, want):
    assert value(spark, S.reweight(F.lit(imp), at(days), F.lit(count), F.lit(pinned), now())) == pytest.approx(want, abs=1e-6)


def test_weights_are_clamped_step_by_step(spark):
    steps = F.array(*[F.lit(x) for x in (5.0, -0.1, -9.0, 0.05)])
    assert value(spark, S.shifted_weight(F.lit(1.0), steps)) == pytest.approx(0.1)


@pytest.mark.parametrize(("dim", "want"), [(64, {"fastapi": (3, 1), "framework": (59, -1), "数据库": (27, 1), "": (61, 1)}), (256, {"fastapi": (131, 1), "framework": (251, -1), "数据库": (27, 1), "": (189, 1)})])
def test_hash_buckets(spark, dim, want):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(want)], "id long, text string")
    got = {r["id"]: (r["idx"], r["value"]) for r in X.hash_buckets(texts, "id", "text", dim).collect()}
    import math

    for i, (idx, sign) in enumerate(want.values()):
        assert got[i] == (idx, pytest.approx(sign * (1 + math.log(2))))


def test_embeddings_have_length_one(spark):
    texts = spark.createDataFrame([(1, "FastAPI web framework"), (2, "")], "id long, text string")
    for r in X.hash_embed(texts, "id", "text", 64).collect():
        assert sum(x * x for x in r["vector"]) == pytest.approx(1.0, abs=1e-6)
    packed = texts.select(X.unpacked(X.packed(F.array(F.lit(1.5), F.lit(-2.0)))).alias("v")).first()["v"]
    assert packed == [1.5, -2.0]
    with pytest.raises(ValueError):
        X.hash_embed(texts, "id", "text", 4)


def test_cosine_of_nothing_is_zero(spark):
    zero, one = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0))
    assert value(spark, X.cosine(zero, one)) == 0.0
    assert value(spark, X.cosine(one, one)) == pytest.approx(1.0)


@pytest.mark.parametrize(("text", "want"), [("改用go重写", []), ("we go on", ["go"]), ("golang echo", ["go"]), ("JavaScript engine", ["java", "go", "nodejs"])])
def test_stacks(spark, text, want):
    assert value(spark, T.stacks(F.lit(text), EngineConfig().stacks)) == want


def test_shift(spark):
    s = EngineConfig().stacks
    both = lambda a, b: value(spark, T.stack_shift(T.stacks(F.lit(a), s), T.stacks(F.lit(b), s)))
    assert both("Java Spring", "改用 golang").asDict() == {"old": "java", "new": "go"}
    assert both("rust", "rust") is None and both("", "rust") is None


def test_strip_is_unicode(spark):
    assert value(spark, T.strip(F.lit("　 a b\t\n"))) == "a b"
    assert value(spark, T.normal_name(F.lit(" Re　DIS "))) == "redis"
