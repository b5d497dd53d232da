from pyspark.sql import functions as F

from conftest import rows
from tickerloom.functions import replies as rp
from tickerloom.operators import chunks as ch, replies as rr


def frame(spark, values, name="reply"):
    return spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, {name} string").orderBy("i")


def test_read_label(spark):
    cases = ["**Growth**.", "growth", "NEUTRAL - risk", "none", "", "The la.bel is mi-xed", "a Risk", None]
    found = [x for (x,) in rows(frame(spark, cases), rp.read_label(F.col("reply")))]
    assert found == ["Growth", "Growth", "Neutral", "Neutral", "Neutral", "Mixed", "Risk", "Neutral"]


def test_inside_fence(spark):
    cases = ["```json\n[1]\n```", "x ```\n[2]\n``` y ```z```", "[3]", "```json[4]", "```"]
    assert [x for (x,) in rows(frame(spark, cases), rp.inside_fence(F.col("reply")))] == ["[1]", "[2]", "[3]", "[4]", ""]


def test_article_analysis(spark):
    good = '{"summary_ko": "s", "sentiment": "긍정", "score": 0.5, "keywords": ["a", "b"], "impact": "i"}'
    cases = [f"```json\n{good}\n```", good, good + " extra", good[:40], '{"sentiment": "x"}', "", '{"score": null}', f"{good},{good}"]
    failed = ("", "분석실패", 0.0, "", "")
    found = rows(rr.with_analysis(frame(spark, cases), F.col("reply")), "summary_ko", "sentiment", "score", "keywords", "impact")
    read = ("s", "긍정", 0.5, "a, b", "i")
    assert found == [read, read, failed, failed, ("", "x", 0.0, "", ""), failed, ("", "", 0.0, "", ""), failed]


def test_call_error_is_told_apart(spark):
    df = spark.createDataFrame([(None, "Timeout"), ("nope", None)], "reply string, error string")
    found = rr.with_analysis(df, F.col("reply"), F.col("error"))
    assert [s for (s,) in rows(found, "sentiment")] == ["오류", "분석실패"]


def chunk(spark, reply, n=3):
    members = [(r, f"d{r}", f"u{r}") for r in range(6, 6 + n)]
    return spark.createDataFrame(
        [("T", 1, members, reply)],
        "ticker string, chunk bigint, rows array<struct<row_id: bigint, date: string, url: string>>, reply string",
    )


def test_replies_by_place_and_by_id(spark):
    whole = '[{"id":5,"title":"a","content":"A"},{"id":6,"제목":"b","내용":"B"},{"id":7,"title":"","content":null}]'
    by_place = rows(ch.zip_replies(chunk(spark, whole)))
    assert by_place == [(6, "T", "d6", "a", "A", "u6"), (7, "T", "d7", "b", "B", "u7"), (8, "T", "d8", "", "", "u8")]
    assert rows(ch.match_replies(chunk(spark, whole))) == by_place
    assert rows(ch.unanswered(chunk(spark, whole))) == []


def test_reply_without_its_middle_item(spark):
    short = '[{"id":5,"title":"a","content":"A"},{"id":7,"title":"c","content":"C"}]'
    assert rows(ch.zip_replies(chunk(spark, short)), "id", "title") == [(6, "a"), (7, "c")]
    assert rows(ch.match_replies(chunk(spark, short)), "id", "title") == [(6, "a"), (8, "c")]
    assert rows(ch.unanswered(chunk(spark, short))) == [("T", 1, 7)]


def test_longer_reply_and_bad_reply(spark):
    longer = '```json\n[{"id":5,"title":"a"},{"id":6,"title":"b"},{"id":9,"title":"x"}]\n```'
    assert rows(ch.zip_replies(chunk(spark, longer, 2)), "id", "title") == [(6, "a"), (7, "b")]
    for bad in ["sorry", "[{", None, '[{"id":5}] and more']:
        assert rows(ch.zip_replies(chunk(spark, bad))) == []
        assert rows(ch.match_replies(chunk(spark, bad))) == []
        assert len(rows(ch.unanswered(chunk(spark, bad)))) == 3


def sections(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, j string")
    return [tuple(r[1:]) for r in rows(rr.section_rows(df, "id", "j"))]


def test_sections(spark):
    text = "📈 **[ 핵심 요약 ]**\n* a\n\n## [긍정 요인]\n b \n[투자 판단]\n투자\n[판단 근거]\nwhy"
    assert sections(spark, text) == [
        ("핵심 요약", "* a\n\n##"), ("긍정 요인", "b"), ("투자 판단", "투자"), ("판단 근거", "why"),
    ]


def test_sections_out_of_order(spark):
    text = "[긍정 요인]\nearly\n[핵심 요약]\nlate"
    # the later heading stands first: the earlier one's body is empty
    assert sections(spark, text) == [("핵심 요약", ""), ("긍정 요인", "early\n[핵심 요약]\nlate")]
    assert sections(spark, "") == [] and sections(spark, None) == [] and sections(spark, "text") == []


def test_section_map(spark):
    df = spark.createDataFrame([("[핵심 요약] x",)], "j string")
    assert rr.with_section_map(df, "j").first()["sections"] == {"핵심 요약": "x"}


def test_verdict(spark):
    cases = ["[투자 판단]\n**비투자**", "[ 투자 판단 ] 투자", "[투자 판단] 보류 [x] 투자", "no heading 투자", "", None, "[투자 판단]투자 아닌 비투자"]
    found = rows(frame(spark, cases), rp.verdict(F.col("reply")), rp.has_verdict(F.col("reply")))
    assert found == [
        ("no", True), ("yes", True), ("hold", True), ("hold", False), ("hold", False), ("hold", False), ("no", True),
    ]
