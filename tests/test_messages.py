import json

import pytest
from pyspark.sql import functions as F

from oncemore.functions import messages as msg
from oncemore.sinks.topics import to_topic
from oncemore.sources.generator import source_message_stream, source_messages
from oncemore.sources.topics import read_topic
from oncemore.streaming.delivery import route, start_enrich_to_topic

GOOD = {
    '{"msg_id":1,"create_time":5,"payload":"xx","extra":{"k":[1,2.5,"s",null]}}': (1, 5, 0),
    '{"msg_id":"12","process_time":7}': (12, 0, 7),
    '{"create_time":3}': (0, 3, 0),
    '{"msg_id":null,"create_time":" 4 "}': (0, 4, 0),
    '{"msg_id":2.9}': (2, 0, 0),
    " \t{}": (0, 0, 0),
}
BAD = ['{"msg_id":1', "\t\n", '[{"msg_id":3}]', "5", "", "null", '{"msg_id":"abc"}', '{"msg_id":{"a":1}}', None]


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_fields(spark):
    good, bad = msg.split_malformed(frame(spark, list(GOOD) + BAD))
    got = {r.value: (r.msg_id, r.create_time, r.process_time) for r in good.collect()}
    assert got == GOOD
    assert sorted(r.value or "" for r in bad.collect()) == sorted(v or "" for v in BAD)
    assert bad.columns == ["value"]


def test_enrich_keeps_other_fields(spark):
    text = '{"msg_id":1,"payload":"a \\"b\\" ü","extra":{"k":[1,2.5,"s",null]},"processor":"old","big":12345678901234567890}'
    out = msg.enrich(frame(spark, [text]), "spark", at=F.lit(77).cast("long")).first().value
    want = json.loads(text) | {"process_time": 77, "processor": "spark"}
    assert json.loads(out) == want


def test_enrich_takes_the_last_of_repeated_fields(spark):
    out = msg.enrich(frame(spark, ['{"msg_id":1,"x":2,"msg_id":3}']), "p").first().value
    assert json.loads(out)["msg_id"] == 3 and json.loads(out)["x"] == 2
    assert msg.parse(frame(spark, [out])).first().msg_id == 3
    again = msg.enrich(frame(spark, ['{"msg_id":1,"processor":"x","msg_id":3}']), "p").first().value
    assert again.count("msg_id") == 1 and json.loads(again)["msg_id"] == 3


def test_text_behind_an_object_is_malformed_everywhere(spark):
    bad = ['{"msg_id":1}{"msg_id":2}', '{"msg_id":1} garbage', '{"msg_id":1},{"msg_id":2}', '{"msg_id":1}]}', '{"msg_id":1}}']
    assert {r.malformed for r in msg.parse(frame(spark, bad)).collect()} == {True}
    assert {r.malformed for r in msg.enrich_or_flag(frame(spark, bad), "p").collect()} == {True}
    good = ['{"a":{"k":1,"k":2}}', ' {"msg_id":1} \n', "{ }"]
    assert {r.malformed for r in msg.parse(frame(spark, good)).collect()} == {False}
    assert {r.malformed for r in msg.enrich_or_flag(frame(spark, good), "p").collect()} == {False}


def test_enrich_leaves_the_rest_of_the_text_alone(spark):
    text = '{"n":123456789012345678901234567890123456789012345678,"d":1.10,"a":{"k":1,"k":2}}'
    out = msg.enrich(frame(spark, [text]), "p", at=F.lit(5).cast("long")).first().value
    assert out == text[:-1] + ',"process_time":5,"processor":"p"}'


def test_enrich_leaves_out_malformed(spark):
    out = msg.enrich(frame(spark, ["{}", '{"a":', "[1]", "7", None]), "p", at=F.lit(1).cast("long"))
    assert [json.loads(r.value) for r in out.collect()] == [{"process_time": 1, "processor": "p"}]


def test_malformed_messages_are_kept_apart(spark):
    flagged = msg.enrich_or_flag(frame(spark, ["{}", '{"a":', None]), "p")
    got = {(r.topic, r.value if r.topic == "dead" else "ok") for r in route(flagged, "result", "dead").collect()}
    assert got == {("result", "ok"), ("dead", '{"a":'), ("dead", None)}
    assert [r.topic for r in route(flagged, "result").collect()] == ["result"]


def test_deliveries_keep_the_position(spark):
    topic = frame(spark, ['{"msg_id":4,"create_time":10}']).select(
        "value", F.lit(2).alias("partition"), F.lit(9).cast("long").alias("offset")
    )
    got = msg.deliveries_of(topic, "a", out_time=F.lit(15)).first()
    assert tuple(got) == ("a", 4, 10, 15, 2, 9)
    clock = msg.deliveries_of(topic, "a").first()
    assert clock.out_time > 1_700_000_000_000


def test_generator(spark):
    got = source_messages(spark, 2500, rate=1000, start_ms=10_000).orderBy("msg_id").collect()
    assert [r.msg_id for r in got] == list(range(1, 2501))
    assert (got[0].create_time, got[999].create_time, got[2499].create_time) == (10_000, 10_999, 12_499)
    assert got[0].payload == "x" * 1000
    keyed = msg.serialise(source_messages(spark, 1, start_ms=0, payload_chars=2), "msg_id", "create_time", "payload")
    assert tuple(keyed.first()) == ("1", '{"msg_id":1,"create_time":0,"payload":"xx"}')
    assert source_message_stream(spark, rate=5).isStreaming


def test_topics_need_the_connector(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)kafka"):
        read_topic(spark, "nowhere:9092", "source", group="g", max_per_trigger=10, min_partitions=4)
    stream = source_message_stream(spark).select(F.lit("{}").alias("value"))
    with pytest.raises(Exception, match="(?i)kafka"):
        start_enrich_to_topic(stream, "p", "nowhere:9092", "result", str(tmp_path), quarantine_topic="dead")
    with pytest.raises(Exception, match="(?i)kafka"):
        to_topic(stream, "nowhere:9092", "result", str(tmp_path), linger_ms="5").start()
