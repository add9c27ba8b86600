import random

import pytest
from pyspark.sql import functions as F

from shelfspark.config import MemoryConfig
from shelfspark.operators import evaluate, memory


def line(role, text, cap=5000):
    body = text.strip().replace("\n", " ")
    body = body[:cap] + "…" if len(body) > cap else body
    return f"{'Người dùng' if role == 'user' else 'Trợ lý'}: {body}" if body else None


def joined(msgs):
    return "\n".join(x for x in (line(r, t) for r, t in msgs) if x)


def tokens(s):
    return int(len(s) / 3.0) + 1 if s else 0


def fit(msgs, budget):
    prior = len(msgs) - 1
    if prior <= 0:
        return 0, 0
    i = 0
    while prior - i > 2 and tokens(joined(msgs[i:prior])) > budget:
        i += 2
    return i, prior - i


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(11)
    out = {0: [("user", "only")], 1: [("user", "a"), ("assistant", "b")], 2: [("user", ""), ("assistant", " \n "), ("user", "x" * 6000), ("user", "q")]}
    for c in range(3, 20):
        out[c] = [(rng.choice(["user", "assistant", "system"]), rng.choice(["", "hi", "line\nbreak " * 5, "y" * rng.randint(1, 900)])) for _ in range(rng.randint(1, 60))]
    out[99] = [("user", "z" * rng.randint(0, 40)) for _ in range(3000)]
    return out


@pytest.fixture(scope="module")
def messages(spark, talks):
    rows = [(c, t, r, x) for c, m in talks.items() for t, (r, x) in enumerate(m)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)


@pytest.mark.parametrize("budget", [256, 20, 5000])
def test_memory_fit_equals_stepwise_folding(messages, talks, budget):
    got = {r["conv_id"]: (r["summarized_idx"], r["kept"], r["history_tokens"]) for r in memory.fit_memory(messages, budget=budget).collect()}
    for c, m in talks.items():
        i, kept = fit(m, budget)
        assert got[c] == (i, kept, tokens(joined(m[i:len(m) - 1]))), c


def test_default_budget_leaves_room_for_prompt(messages):
    got = memory.fit_memory(messages, MemoryConfig(token_limit=2000), system_tokens=100).filter("conv_id = 99").first()
    # 1500 - (100 + int(800*5/3) + 64 + tokens of the question) is below the floor of 256.
    assert 0 < got["history_tokens"] <= 256


def test_suffix_sums_over_many_blocks(spark):
    rows = [(k, p, (p * 7) % 5) for k, n in (("hot", 500), ("cold", 3)) for p in range(n)]
    df = spark.createDataFrame(rows, "k string, p long, v long")
    got = {(r["k"], r["p"]): r["v_after"] for r in memory.suffix_sums(df, "k", "p", ["v"], block=16).collect()}
    for k, p, _ in rows:
        assert got[(k, p)] == sum(v for kk, pp, v in rows if kk == k and pp >= p)


def test_history_and_last_turns(messages, talks):
    got = {r["conv_id"]: r["history"] for r in memory.format_history(messages, MemoryConfig(window=2)).collect()}
    for c, m in talks.items():
        assert got.get(c, "") == joined(m[-4:])
    assert memory.last_turns(messages, 1).filter("conv_id = 99").count() == 2


def test_prompt_text(spark):
    q = spark.createDataFrame([(1, "ask"), (2, "none")], "query_id long, query string")
    c = spark.createDataFrame([(1, 2, "t2", "B", None, True), (1, 1, "t1" * 500, None, "A", True)], "query_id long, source_idx long, text string, title string, author string, low_confidence boolean")
    h = spark.createDataFrame([(1, "Người dùng: hi")], "query_id long, history string")
    p = {r["query_id"]: r["prompt"] for r in memory.build_prompts(c, q, "S", "!", "NOTE\n", h).collect()}
    assert p[1] == ("S\n\nNOTE\nNgười dùng: hi\n\n=== [NGỮ CẢNH] — CÁC ĐOẠN VĂN BẢN LIÊN QUAN ===!\n"
                    "\n--- Nguồn [1] ---\nTài liệu: Không rõ | Tác giả: A\n" + "t1" * 400 + "\n"
                    "\n--- Nguồn [2] ---\nTài liệu: B | Tác giả: Không rõ\nt2\n\n=== CÂU HỎI ===\nask\n\n=== CÂU TRẢ LỜI ===")
    assert "Nguồn [" not in p[2]


def test_answer_rules(spark):
    rows = [("a", "Nam Cao [1]", ["nam cao"], False), ("b", "Nam Cao", ["nam cao"], False), ("c", "Xin lỗi, không tìm thấy", [], True), ("d", "x [1]", [], True), ("e", "x 📚", [], False)]
    df = spark.createDataFrame(rows, "case_type string, answer string, expect_keywords array<string>, expect_fallback boolean")
    checked = evaluate.check_answers(df)
    assert {r["case_type"]: r["passed"] for r in checked.collect()} == {"a": True, "b": False, "c": True, "d": False, "e": True}
    total = evaluate.answer_summary(checked).filter("case_type = 'ALL'").first()
    assert (total["n"], total["n_passed"], total["pass_pct"], total["citation_pct"]) == (5, 3, 60.0, 60.0)


def test_metrics_divide_by_k(spark):
    flags = spark.createDataFrame([("m", 1, 0, False), ("m", 1, 1, True)], "mode string, query_id long, rank long, relevant boolean")
    ran = spark.createDataFrame([("m", 1, "FACTUAL"), ("m", 2, "AUTHOR")], "mode string, query_id long, query_type string")
    m = {(r["query_id"], r["k"]): r for r in evaluate.query_metrics(flags, ran, (1, 5)).collect()}
    assert (m[(1, 5)]["precision"], m[(1, 5)]["mrr"], m[(1, 1)]["mrr"], m[(1, 1)]["precision"], m[(1, 5)]["n_retrieved"]) == (0.2, 0.5, 0.5, 0.0, 2)
    assert m[(2, 5)]["n_retrieved"] == 0
    avg = {(r["query_type"], r["k"]): r for r in evaluate.macro_average(evaluate.query_metrics(flags, ran, (1, 5))).collect()}
    assert avg[("ALL", 5)]["precision"] == 0.1 and avg[("FACTUAL", 5)]["precision"] == 0.2


def test_export_is_one_block_per_message(messages):
    r = memory.export_messages(messages).filter((F.col("conv_id") == 1) & (F.col("turn") == 0)).first()
    assert r["json"] == '{"role":"user","content":"a"}' and r["txt"] == "👤 Người dùng:\na\n" + "-" * 50
