import hashlib
import random

from pyspark.sql import functions as F

from barloom.llm import chat
from barloom.llm.queries import op6_chat_format

SCHEMA = "conv_id long, turn long, role string, text string"
CONTROL = ["<turn assistant>", "</turn>", "<part>", "\\", "\\l", "\\b<", "\\g>", "<", ">", "\n", "", "é🙂", "\\\\bl", "plain text", "### Assistant:"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    done = []
    for conv, turns in out.items():
        turns.sort()
        learned = "".join(t for *_, r, t in turns if r == "assistant")
        done.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(learned), digest(learned)))
    return sorted(done, key=str)


def read_back(df):
    seen = chat.format_chats(df).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.learned_text(F.col("segments")).alias("l"), "segments").collect()
    for r in seen:
        assert "".join(s.text for s in r.segments) == r.formatted
        # Each run of a role is one block.
        assert r.formatted.count("<turn ") == sum(k == 0 or r.t[k - 1].role != t.role for k, t in enumerate(r.t))
    return sorted(((r.conv_id, len(r.t), digest("".join(f"{t.role}\n{t.text}\n" for t in r.t)), len(r.l), digest(r.l)) for r in seen), key=str)


def odd_chats():
    rng = random.Random(3)
    roles = ["user", "assistant", "assistant", "system", None, "we<ird> \\g", ""]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, 1, None]), rng.choice(roles), rng.choice([None, *CONTROL, "".join(rng.choices(CONTROL, k=4))])))
    rows += [(None, 0, "assistant", "x"), (None, 1, "user", "y"), (100, 0, "user", "again"), (100, 0, "user", "again")]
    rows += [(200, k, "assistant" if k % 3 else "user", f"turn {k} <") for k in range(3000)]
    return rows


def test_turns_and_learned_text_come_back(spark):
    rows = odd_chats()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit("x")).withColumn("segments", F.lit(1)).withColumn("turns", F.lit(2))
    assert read_back(df.repartition(5)) == brute(rows)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(odd_chats()[:9], SCHEMA)
    assert "python" not in chat.format_chats(df)._jdf.queryExecution().toString().lower()


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    assert sorted((tuple(r)[:5] for r in op6_chat_format(spark, d).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
