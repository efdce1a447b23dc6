import json

from tallywright import schema
from tallywright.operators import prompts

FULL = '{"summary": "s", "problems": ["p"], "recommendations": ["r", "t"]}'


def reports(spark):
    return spark.createDataFrame(
        [("t", "sales", 0, 0, '{"n":['), ("t", "sales", 2, 0, "]}"),
         ("m", "marketing", 0, 0, '{"n":['), ("m", "marketing", 1, 0, "1"),
         ("m", "marketing", 1, 1, ",2"), ("m", "marketing", 2, 0, "]}")],
        "tenant STRING, domain STRING, part INT, position BIGINT, text STRING",
    )


def joined(rows, column="prompt"):
    return "".join(r[column] for r in sorted(rows, key=lambda r: (r.part, r.position)))


def test_insight_prompts(spark):
    rows = prompts.insight_prompts(reports(spark)).collect()
    got = {(r.tenant, r.part): r for r in rows}
    assert joined(r for r in rows if r.tenant == "t") == 'Here is the KPI data:\n\n{"n":[]}'
    assert got["t", 0].system_prompt == schema.SYSTEM_PROMPTS["sales"]
    assert got["m", 0].system_prompt.startswith("You are an expert Marketing analyst")


def test_chat(spark):
    questions = spark.createDataFrame(
        [(1, "t", "why?"), (2, "m", "how?"), (2, "m", "and?"), (3, "none", "who?")],
        "conv_id INT, tenant STRING, question STRING",
    )
    history = spark.createDataFrame(
        [(2, 4, "user", "b"), (2, 1, "assistant", "a"), (3, 0, "user", "lost")],
        "conv_id INT, turn INT, role STRING, text STRING",
    )
    asked = prompts.chat_prompts(questions, reports(spark), ("tenant",))
    assert joined(asked.where("conv_id = 1").collect()) == (
        'Business sales KPI data:\n{"n":[]}\n\nUser question: why?\n\n'
        "Answer using only the data above. Be specific and concise."
    )
    how = joined(asked.where("conv_id = 2 AND question = 'how?'").collect())
    assert how.startswith('Business marketing campaign KPI data:\n{"n":[1,2]}\n\nUser question: how?')
    messages = prompts.chat_messages(asked, history, "conv_id")
    heads = messages.where("part = 0").orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.turn, r.role) for r in heads] == [
        (1, 0, "user"), (2, 1, "assistant"), (2, 4, "user"), (2, 5, "user"), (2, 6, "user"),
    ]
    assert joined(messages.where("conv_id = 2 AND turn = 6").collect(), "text") == how
    _, waiting = prompts.split_by_readiness(questions, reports(spark), ("tenant",))
    assert [r.conv_id for r in waiting.collect()] == [3]


def test_replies(spark):
    raws = {
        "fenced": f"\n```json\n{FULL}\n```\n",
        "plain fence": f"```{FULL}```",
        "bare": FULL,
        "partial": '{"summary": "s"}',
        "array": "[1, 2]",
        "prose": " Sales rose.\n",
        "blank": "  ",
        "cut": '```json\n{"summary": "s',
    }
    df = spark.createDataFrame(list(raws.items()), "k STRING, raw STRING")
    got = {r.k: r for r in prompts.parse_replies(df).collect()}
    whole = json.loads(FULL)
    for k in ("fenced", "plain fence", "bare"):
        assert got[k].parsed
        assert [got[k][f] for f in whole] == list(whole.values())
    assert got["partial"].parsed and got["partial"].problems is None
    assert got["array"].parsed and got["array"].summary is None
    for k in ("prose", "blank", "cut"):
        assert not got[k].parsed
        assert (got[k].summary, got[k].problems, got[k].recommendations) == (raws[k], [], [])


def test_replies_are_json_exactly_when_the_standard_library_says_so(spark):
    texts = [
        '{"summary":"x"} and more', '{"summary":"x"}{"summary":"y"}', "{'summary':'x'}",
        """{'a"b': 'c"d'}""", """{"a": "it's \\\\", "b": "'"}""", '{"a": "%s"}' % ("x'\\n" * 50_000),
        '{"summary":"a\nb"}', '{"summary":"x",}', "null", '"text"', "12", "1, 2", "1], [2",
        '{"a": "x\\q"}', '{"a": "\\u12"}', '{"a": "\t"}', '{\t"a": 1\n}', '{"a": "\\/\\b"}',
        '1}, {"value":2', '1, "k": 2', "01", "true", "[]", "{}", "", "]", '{"a":1e999}', "tru",
        '{"summary":"x","summary":"y"}', '{"summary":"\\u00e9"}',
    ]
    df = spark.createDataFrame([(t,) for t in texts], "raw STRING")
    got = {r.raw: r for r in prompts.parse_replies(df).collect()}
    for text in texts:
        try:
            json.loads(text)
            want = True
        except json.JSONDecodeError:
            want = False
        assert got[text].parsed == want, text
    assert got['{"summary":"x","summary":"y"}'].summary == "y"
    assert got['{"summary":"\\u00e9"}'].summary == "\u00e9"
