import hashlib
import re

import pytest
from pyspark.sql import functions as F

from spectrafold.llm.chat import escape, fold, format_chats, parse_chats, turn_events, unescape
from spectrafold.llm.fingerprints import _LANES as LANES
from spectrafold.llm.fingerprints import combine, fingerprint_documents, lanes, likeness, with_next
from spectrafold.llm.mixing import mix, mix_rows, targets


def test_targets():
    got = targets([(None, 100), ("b", 10), ("a", 1000)])
    assert got == {"b": 30.0, "a": 270.0, None: 300.0} or got["b"] == 30 and got[None] == 300
    assert sum(got.values()) <= 1110 + 1e-9
    even = targets([("a", 600), ("b", 600), ("c", 600)])
    assert even == {"a": 300.0, "b": 600.0, "c": 900.0}
    assert targets([]) == {}


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check_mix(rows, got, tolerance=1.0):
    size, goal = {}, targets([(s, sum(words(t) for _, t, u in rows if u == s)) for s in {s for _, _, s in rows}])
    for _, t, s in rows:
        size[s] = size.get(s, 0) + words(t)
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-6
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in taken.items():
        assert abs(t - goal[s]) <= tolerance, s


def test_mix(spark, make_docs):
    rows = [(k, "w " * (k * 7 % 40), f"s{k * k % 5}" if k % 11 else None) for k in range(200)] + [(900, None, "s1"), (901, "", "empty")]
    docs = make_docs(rows)
    got = mix(docs).collect()
    assert len(got) == len(rows)
    check_mix(rows, got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(docs).collect()), key=str)
    times = {r["doc_id"]: r["copies"] for r in got}
    copied = mix_rows(docs)
    assert copied.columns == docs.columns
    count = {r["doc_id"]: r["n"] for r in copied.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(count.get(i, 0) - n in (0, 1) for i, n in times.items())


def test_mix_odd_tables(spark, make_docs):
    assert mix(make_docs([])).count() == 0
    assert [r["taken"] for r in mix(make_docs([(1, None, None), (2, "", "a")])).collect()] == [0, 0]
    rows = [(None, "a b c", "x"), (None, "a b c", "x"), (3, "a b c", "x"), (4, "q " * 50, "y")]
    check_mix(rows, mix(make_docs(rows)).collect(), tolerance=3.0)


def test_mix_query(spark, sf):
    from spectrafold.llm.queries import documents

    docs = documents(spark, sf)
    check_mix([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], mix(docs).collect())


@pytest.mark.parametrize("text", ["", "plain", "</s>", "[INST][/INST]", "\\", "\\</s>", "<\\/s>", "<\\\\/s>", "[\\INST]", "a\\\\b</s>\\", "<s>[SYS][/SYS]</s></s>"])
def test_escape(spark, text):
    row = spark.range(1).select(escape(F.lit(text)).alias("e")).select("e", unescape(F.col("e")).alias("u")).head()
    assert row["u"] == text
    assert not re.search(r"</?s>|\[/?INST\]", row["e"])


def test_fold_deltas_edits_regenerations(spark):
    log = [(1, 0, 0, "delta", "user", "Hel"), (1, 0, 1, "delta", None, "lo"), (1, 1, 2, "delta", "assistant", "bad"), (1, 2, 3, "delta", "user", "gone"), (1, 1, 4, "regenerate", None, None), (1, 1, 5, "delta", "assistant", "good"), (1, 0, 6, "edit", None, "Hi"), (1, 0, 7, "delta", None, "!"), (1, 2, 8, None, "user", "next"), (2, None, 0, "delta", None, None), (None, 0, None, "delta", "user", "x")]
    got = fold(spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string")).orderBy("conv_id", "message")
    assert [(r["conv_id"], r["role"], r["text"]) for r in got.collect()] == [(None, "user", "x"), (1, "user", "Hi!"), (1, "assistant", "good"), (1, "user", "next"), (2, "", "")]
    assert fold(spark.createDataFrame([], "conv_id long, message long, seq long, kind string, role string, text string")).count() == 0


def test_chat_query(spark, sf):
    from spectrafold.llm.queries import op7_chat

    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    turns[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in op7_chat(spark, sf).collect()}
    assert got.keys() == turns.keys()
    for k, said in turns.items():
        learned = "".join(t for role, t in said if role == "assistant")
        assert got[k]["n_turns"] == len(said) and got[k]["loss_chars"] == len(learned)
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert got[k]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()


def test_chat_ties_and_nulls(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", None), (None, 1, None, "t"), (3, 0, "assistant", "\U0001f600 é\n" * 2000)]
    read = parse_chats(format_chats(fold(turn_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))).collect()
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in read}
    assert got == {1: [("assistant", ""), ("user", "a"), ("user", "a"), ("user", "b")], None: [("", "t")], 3: [("assistant", rows[-1][3])]}
    assert {r["conv_id"]: "".join(r["learned"]) for r in read}[3] == rows[-1][3]


def test_fingerprints(spark, make_docs):
    a, b = "One two three. Four five!\nSix seven.\n", "Six seven.\nOne two three. Four five!\n"
    rows = [(1, a, ""), (2, b, ""), (3, a, ""), (4, a + "New line.\n", ""), (5, None, ""), (6, "", ""), (7, "New line.\n", "")]
    got = {r["doc_id"]: r["lanes"] for r in fingerprint_documents(make_docs(rows)).collect()}
    assert got[1] == got[3] and got[5] == got[6] and got[1] != got[4] and len(got) == 7
    pieces = spark.createDataFrame([(got[4], got[7], got[1])], "x array<long>, y array<long>, z array<long>")
    row = pieces.select(combine(F.col("x"), F.col("y"), -1).alias("minus"), combine(F.col("z"), F.col("y")).alias("plus"), likeness(F.col("x"), F.col("z")).alias("near"), likeness(F.col("z"), F.col("z")).alias("same")).head()
    assert row["minus"] == got[1] and row["plus"] == got[4] and row["same"] == 1.0 and 0.5 < row["near"] < 1
    lines = ["first line.", "second line!", "third line"]
    one, two = ("\n".join(lines) + "\n", "\n".join(reversed(lines)) + "\n")
    got = spark.createDataFrame([(one, two)], "a string, b string").select((lanes(F.col("a")) == lanes(F.col("b"))).alias("e")).head()
    assert got["e"]


def test_fingerprint_of_an_unterminated_paragraph(spark):
    long = "Five words of a sentence, " * 9 + "end. More"
    rows = [("A\n\nB", "B\n\nA", "A", "B"), (f"{long}\r\nB.", f"B.\r\n{long}", long, "B."), ("x | y\n!\n?", "?\n\n!\nx | y\n", "x | y", "?\n!")]
    one, two, first, rest = (lanes(F.col(c)) for c in ("one", "two", "first", "rest"))
    got = spark.createDataFrame(rows, "one string, two string, first string, rest string").select((one == two).alias("moved"), (combine(first, rest) == one).alias("added"), (combine(two, rest, -1) == first).alias("cut"), (one == first).alias("same"))
    assert [tuple(r) for r in got.collect()] == [(True, True, True, False)] * 3


def test_fingerprint_of_many_pieces(spark):
    """Lanes beyond 2**20, and twice a lane beyond it, don't reach their neighbours."""
    made = spark.range(1).select(F.repeat(F.lit("a\n"), 1_100_000).alias("a"), F.repeat(F.lit("b\n"), 1_100_000).alias("b"), F.lit("a\nb\n").alias("c"))
    held = made.select("a", "b", "c", F.concat("a", "b").alias("ab")).select(*[lanes(F.col(c)).alias(c) for c in ("a", "b", "c", "ab")])
    row = held.select((combine(F.col("a"), F.col("b")) == F.col("ab")).alias("added"), (combine(F.col("ab"), F.col("b"), -1) == F.col("a")).alias("cut"), likeness(F.col("ab"), F.col("c")).alias("like"), F.get("ab", F.lit(0)).alias("n"), F.slice("ab", 2, LANES).alias("sums"), F.slice("c", 2, LANES).alias("ones")).head()
    assert row["added"] and row["cut"] and row["n"] == 2_200_000 and abs(row["like"] - 1) < 1e-9
    assert row["sums"] == [1_100_000 * k for k in row["ones"]] and set(row["ones"]) == {0, 1, 2}


def test_fingerprint_query(spark, sf):
    from spectrafold.llm.queries import op8_fingerprints

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids, got = sorted(docs, reverse=True), {r["doc_id"]: r for r in op8_fingerprints(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for k, i in enumerate(ids):
        t, n = docs[i], docs[ids[(k + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
    assert len({(r["fingerprint"]) for r in got.values()}) == len(set(docs.values()))
    assert sum(r["near_edited"] > r["near_next"] for r in got.values()) > 0.97 * len(got)


@pytest.mark.parametrize("n", [1, 2, 7])
def test_next_document(spark, n):
    rows = [(k * k, f"t{k}") for k in range(20)] + [(4, "again"), (None, "none")]
    got = with_next(spark.createDataFrame(rows, "doc_id long, text string"), n).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = {(*r, order[(k + 1) % len(order)][1]) for k, r in enumerate(order)}
    assert {(r["doc_id"], r["text"], r["next_text"]) for r in got} == want and len(got) == len(rows)
    assert with_next(spark.createDataFrame([], "doc_id long, text string"), n).count() == 0
    assert with_next(spark.createDataFrame([(1, "a")], "doc_id long, text string"), n).head()["next_text"] == "a"
