import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quorumlens.llm import chat

KINDS = "conv_id bigint, turn bigint, role string, text string"


def spoken(rows):
    """conv_id -> turns in order."""
    held = {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, []).append((turn is None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns, key=lambda t: t[:3])] for c, turns in held.items()}


def n_tokens(text):
    return chat.MARKS + len(re.findall(chat.TOKEN, text))


def corpus(seed, convs, most):
    rnd = random.Random(seed)
    bits = ["word", "### ", "</turn>", "\\", "#", "<", "</turn>\n", ": ", "\n", "é日", "12345", "#\\## x", "<\\/turn>", "%25", "😀"]
    out = []
    for conv in range(convs):
        for turn in range(rnd.randint(1, most)):
            role = "system" if turn == 0 and conv % 3 == 0 else ("user", "assistant")[turn % 2]
            text = "".join(rnd.choice(bits) for _ in range(rnd.choice([0, 3, 8, 40])))
            out.append((conv, turn, role, text if rnd.random() < 0.95 else None))
    return out


def check(df, rows, budget, history):
    """The windows hold every turn once as new, in order, in the budget, with the history and the loss of the definition."""
    found = df.collect()
    turns = spoken(rows)
    by = {}
    for w in sorted(found, key=lambda w: w["position"]):
        by.setdefault(w["conv_id"], []).append(w)
    assert by.keys() == turns.keys()
    for conv, said in turns.items():
        formatted = []
        for role, text in said:
            body = re.sub(r"(<\\*)(/turn>)", r"\1\\\2", re.sub(r"(#\\*)(## )", r"\1\\\2", text))
            formatted.append((f"### {role}: {body}</turn>\n", n_tokens(body), role, body, text))
        at, loss = 0, ""
        system = formatted[0] if said[0][0] == "system" and len(said) > 1 else None
        for number, w in enumerate(by[conv]):
            first = at
            carried = []
            if number:
                size = 0
                for k in range(at - 1, 0 if system else -1, -1):
                    size += formatted[k][1]
                    if size > history:
                        break
                    carried.insert(0, formatted[k])
                if system:
                    carried.insert(0, system)
            lead = "".join(x[0] for x in carried)
            assert w["carried"] == len(carried) and w["text"].startswith(lead)
            rest, spans, place = w["text"][len(lead):], [], len(lead)
            while rest:
                body, tokens, role, escaped, text = formatted[at]
                assert rest.startswith(body)
                if role == "assistant" and escaped:
                    spans.append((place + len(f"### {role}: "), len(escaped)))
                rest, place, at = rest[len(body):], place + len(body), at + 1
            assert [tuple(x) for x in w["loss"]] == spans
            new = sum(x[1] for x in formatted[first:at])
            assert w["n_tokens"] == new + sum(x[1] for x in carried)
            if system is None or system[1] <= budget // 4:
                assert w["n_tokens"] <= budget or at - first - (system is not None and number == 0) == 1
        assert at == len(said)
    return found


@pytest.mark.parametrize("budget, history", [(120, 30), (60, 0), (4000, 500), (200, 50)])
def test_windows_hold_each_turn_once_and_repeat_what_the_definition_says(spark, budget, history):
    rows = [*corpus(1, 25, 60), (100, None, "user", "null turn"), (100, 0, None, "</turn>"), (None, 1, "assistant", "no id"), (None, 0, "user", "hi")]
    check(chat.windows(spark.createDataFrame(rows, KINDS).repartition(3), budget, history), rows, budget, history)


def test_digests_are_read_back_from_the_text(spark):
    rows = [*corpus(2, 30, 50), (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    formatted = chat.windows(spark.createDataFrame(rows, KINDS), 150, 40)
    found = {r["conv_id"]: r for r in chat.digests(formatted, stretch=90).collect()}
    lengths = {r["conv_id"]: r["n"] for r in formatted.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).collect()}
    for conv, said in spoken(rows).items():
        answers = "".join(text for role, text in said if role == "assistant")
        assert found[conv].asDict() == {
            "conv_id": conv,
            "n_turns": len(said),
            "turns_sha256": hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in said).encode()).hexdigest(),
            "loss_chars": len(answers),
            "loss_sha256": hashlib.sha256(answers.encode()).hexdigest(),
            "formatted_chars": lengths[conv],
        }


def test_equal_turns_repeated_rows_and_odd_roles(spark):
    rows = [(1, 0, "user", "same")] * 3 + [(1, 0, "a:b\n<#%", "x")] + [(1, 1, "assistant", "")]
    formatted = chat.windows(spark.createDataFrame(rows, KINDS))
    turns = [tuple(t) for w in chat.read_back(formatted).collect() for t in w["turns"]]
    assert turns == [("a:b\n<#%", "x"), ("user", "same"), ("user", "same"), ("user", "same"), ("assistant", "")]


def test_clashing_columns_empty_table_and_long_text(spark):
    df = spark.createDataFrame([(1, 0, "user", "q " * 20000), (1, 1, "assistant", "a")], KINDS)
    extra = df.withColumns({"row": F.lit(1), "kind": F.lit("k"), "tokens": F.lit(2), "position": F.lit(3), "conversation": F.lit(4)})
    check(chat.windows(extra), [tuple(r) for r in df.collect()], chat.BUDGET, chat.HISTORY)
    assert chat.digests(chat.windows(df.limit(0))).collect() == []


def test_no_python_in_the_plan(spark, folder):
    df = chat.digests(chat.windows(spark.read.parquet(f"{folder}/conversations.parquet")))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
