"""Request bodies as JSON text, made from conversations: each breaks one rule or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.sources.views import turns

# The bodies by (conv_id * 7 + turn) % their number. {t} stands for the turn's text as a JSON text
# and {r} for its role. The check reads the same lists.
TURN = '{"role":"user","content":"a"}'
LONG_TURN = '{"role":"user","content":"' + "a" * 4000 + '"}'
REQUESTS = [
    '{"message":{t}}',
    '{"message":"  "}',
    '{"message":"' + "a" * 4001 + '"}',
    '{"message":42}',
    "{}",
    '{"message":{t},"bookIds":["b"]}',
    '{"message":{t},"history":[{"role":"system","content":"hidden"}]}',
    '{"message":{t},"history":[' + ",".join([TURN] * 21) + "]}",
    '{"message":{t},"history":[' + ",".join([LONG_TURN] * 5) + "]}",
    "[]",
    '{"message":',
    '{"message":{t},"symptoms":[' + ",".join(['"s"'] * 16) + "]}",
    '{"message":{t},"symptoms":["a"," "]}',
    '{"message":{t},"diseases":["' + "d" * 201 + '"]}',
    '{"message":{t},"summary":""}',
    '{"message":{t},"history":[{"role":"{r}","content":{t}}],"summary":"s","symptoms":[" a "],"diseases":[]}',
    '{"message":{t},"history":[{"role":"user","content":" "}]}',
    '{"message":{t},"symptoms":"a"}',
    '{"message":""}',
    '{"message":{t},"diseases":[1]}',
    '{"message":{t},"history":null}',
    '{"message":{t},"history":[{"role":"user","content":"a","id":1}]}',
]
COMPACTS = [
    '{"history":[' + ",".join([TURN] * 3) + "]}",
    '{"history":[' + ",".join([TURN] * 2) + "]}",
    '{"history":[{"role":"{r}","content":{t}},' + TURN + "," + TURN + '],"summary":"s"}',
    '{"summary":"s"}',
    '{"history":[' + ",".join([LONG_TURN] * 4) + '],"summary":"s"}',
    '{"history":[' + ",".join([TURN] * 3) + '],"message":"m"}',
    '{"history":[' + ",".join([TURN] * 3) + '],"summary":" "}',
]
SOURCE = (
    '{"id":"c/b/1","bookId":"b","bookTitle":"B","author":null,"remedyName":"R","sectionTitle":"S","passageIndexes":[0,1],'
    '"text":"x"}'
)
MESSAGE = '{"id":0,"role":"user","content":{t}}'
CHATS = [
    '{"title":"T","updatedAt":1,"messages":[' + MESSAGE + '],"history":[]}',
    '{"title":"","updatedAt":1,"messages":[' + MESSAGE + '],"history":[]}',
    '{"title":"' + "t" * 201 + '","updatedAt":1,"messages":[' + MESSAGE + '],"history":[]}',
    '{"title":"T","updatedAt":1.5,"messages":[' + MESSAGE + '],"history":[]}',
    '{"title":"T","updatedAt":-1,"messages":[' + MESSAGE + '],"history":[]}',
    '{"title":"T","updatedAt":1,"messages":[],"history":[]}',
    '{"title":"T","updatedAt":1,"messages":[' + ",".join(['{"id":1,"role":"user","content":"x"}'] * 401) + '],"history":[]}',
    '{"title":"T","updatedAt":1,"messages":[{"id":0,"role":"{r}","content":{t},"sources":[' + SOURCE + ']}],"history":[]}',
    '{"title":"T","updatedAt":1,"messages":[{"id":0,"role":"user","content":{t},"sources":['
    + ",".join([SOURCE] * 21)
    + ']}],"history":[]}',
    '{"title":"T","updatedAt":1,"messages":[' + MESSAGE + '],"history":[{"role":"{r}","content":{t}}],"summary":"s"}',
    '{"title":"T","updatedAt":1,"messages":[' + MESSAGE + '],"history":[],"pinned":true}',
    '{"title":"T","updatedAt":1,"messages":[{"id":0,"role":"user","content":{t},"status":"x"}],"history":[]}',
    '{"title":"T","updatedAt":1,"messages":[' + MESSAGE + '],"history":[],"summary":1}',
    '{"title":"T","updatedAt":1,"messages":[{"id":0,"role":"user","content":{t},"sources":['
    + SOURCE.replace("[0,1]", "[-1]")
    + ']}],"history":[]}',
]
RATED = '{"question":{t},"answer":"a","rating":"down","sources":[]'
FEEDBACK = [
    RATED + "}",
    RATED + ',"reasons":["unclear","wrong_remedy"],"comment":"  so  "}',
    RATED + ',"reasons":["unclear","unclear"]}',
    RATED + ',"reasons":["other"]}',
    RATED + ',"comment":"' + "c" * 1001 + '"}',
    RATED + ',"comment":"   "}',
    RATED + ',"mood":1}',
    '{"question":{t},"answer":"a","rating":"up","sources":[],"reasons":["unclear"]}',
    '{"question":{t},"answer":"a","rating":null,"sources":[{"id":"i","cited":true,"rating":"up"}]}',
    '{"question":{t},"answer":"a","rating":"up","sources":[{"id":"i","cited":1,"rating":"up"}]}',
    '{"question":{t},"answer":"","rating":"up","sources":[]}',
    '{"question":"","answer":"a","rating":"up","sources":[]}',
    '{"question":{t},"answer":"a","rating":"meh","sources":[]}',
    '{"question":{t},"answer":"a","sources":[]}',
]


def bodies(spark: SparkSession, sf: str, kinds: list[str]) -> DataFrame:
    """(conv_id, turn, body)."""
    text = F.to_json(F.array("text"))
    quoted = F.substring(text, F.lit(2), F.length(text) - 2)
    which = (F.col("conv_id") * 7 + F.col("turn")) % len(kinds)

    def filled(template: str) -> Column:
        return F.replace(F.replace(F.lit(template), F.lit("{r}"), F.col("role")), F.lit("{t}"), quoted)

    body = F.lit(None).cast("string")
    for number, template in enumerate(kinds):
        body = F.when(which == number, filled(template)).otherwise(body)
    return turns(spark, sf).select("conv_id", "turn", body.alias("body"))


def bodies_sql(kinds: list[str]) -> str:
    """The same bodies as SQL."""
    cases = " ".join(f"WHEN {number} THEN '{template}'" for number, template in enumerate(kinds))
    return f"""SELECT conv_id, turn, replace(replace(CASE (conv_id * 7 + turn) % {len(kinds)} {cases} END, '{{r}}', role),
                      '{{t}}', CAST(to_json(text) AS VARCHAR)) AS body FROM conversations"""
