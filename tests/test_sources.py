import json

import pytest
from pyspark.sql import functions as F

from opinara import schemas, vocab
from opinara.plans import collect, prepare
from opinara.session import scratch_path
from opinara.sources import flatten, readers, sinks


def raw(spark, schema, **values):
    """One raw row, defaults for what is not given."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = dict(c.split() for c in schema.split(", "))
    default = {"string": "x", "int": 1, "bigint": 1, "double": 0.5, "boolean": True}
    return tuple(values.get(n, default[kinds[n]]) for n in names)


def test_csv_round_trip(spark):
    path = scratch_path(spark, "t")
    text = ' line one\nline "two", three\r\n'
    sinks.write_csv(spark.createDataFrame([raw(spark, schemas.RAW_A, text=text, likes=-3)], schemas.RAW_A), path)
    row = readers.read_platform(spark, path, vocab.PLATFORM_A).first()
    assert (row["text"], row["likes"], row["contains_ai"]) == (text, -3, True)


def test_missing_path_is_reported(spark):
    with pytest.raises(readers.MissingData):
        readers.read_final(spark, "/nowhere/final", "parquet")
    with pytest.raises(readers.MissingData):
        readers.read_final(spark, "/nowhere/final")


def test_file_order_follows_the_file(spark):
    path = scratch_path(spark, "t")
    spark.range(50).select(F.col("id").cast("string").alias("text")).coalesce(1).write.json(path)
    rows = readers.with_file_order(spark.read.schema("text string").json(path)).orderBy("source_file", "block_start", "row_order")
    assert [r["text"] for r in rows.collect()] == [str(i) for i in range(50)]


def test_threads_use_defaults_for_missing_keys(spark):
    full = {"snippet": {"topLevelComment": {"snippet": {"textDisplay": " hi ", "likeCount": 4, "publishedAt": "2024-01-01T00:00:00Z", "id": "c1"}}, "totalReplyCount": 2}}
    bare = {"snippet": {"topLevelComment": {"snippet": {}}}}
    dump = json.dumps({"video_id": "v", "items": [full, bare]})
    rows = spark.createDataFrame([(dump,)], "j string").select(F.from_json("j", schemas.THREADS).alias("r")).select("r.*")
    out = flatten.flatten_threads(rows).orderBy("position").collect()
    assert [(r["raw_text"], r["likes"], r["num_replies"], r["source_id"]) for r in out] == [
        ("hi", 4, 2, "youtube_comment_c1"), ("", 0, 0, "youtube_comment_None")]


def test_videos_with_text_counts(spark):
    item = {"id": "v", "snippet": {"title": "T", "publishedAt": "bad"}, "statistics": {"viewCount": "12"}}
    rows = spark.createDataFrame([(json.dumps({"items": [item]}),)], "j string").select(F.from_json("j", schemas.VIDEOS).alias("r")).select("r.*")
    r = flatten.flatten_videos(rows).first()
    assert (r["video_view_count"], r["video_comment_count"], r["video_channel"], r["video_published_date"]) == (12, 0, "", None)


def comment(i, body, replies=()):
    return {"id": i, "body": body, "score": 1, "created_utc": 1700000000.0, "replies": list(replies)}


def test_comment_trees_of_any_depth(spark):
    deep = comment("e", "five")
    for i, name in zip("dcba", ("four", "three", "two", "one")):
        deep = comment(i, name, [deep])
    post = {"id": "p", "title": "T", "comments": [deep, comment("z", "[deleted]", [comment("y", "below deleted")])]}
    path = scratch_path(spark, "t")
    spark.createDataFrame([(json.dumps(post),)], "value string").write.text(path)
    out = flatten.flatten_comment_trees(spark.read.schema(schemas.POSTS).json(path)).collect()
    assert sorted((r["depth"], r["text"], r["num_replies"]) for r in out) == [
        (0, "one", 1), (1, "below deleted", 0), (1, "two", 1), (2, "three", 1), (3, "four", 1), (4, "five", 0)]


@pytest.mark.parametrize("levels", [1, 7, 50, 64])
def test_a_chain_of_fifty_replies(spark, levels):
    deep = comment("c49", "49")
    for i in reversed(range(49)):
        deep = comment(f"c{i}", str(i), [deep, comment(f"d{i}", f"side {i}")])
    posts = [("p", json.dumps([deep])), ("none", None), ("empty", "[]"), ("broken", "{"), ("text", '""'), ("null", "null")]
    out = flatten.flatten_comment_trees(spark.createDataFrame(posts, "id string, comments string"), levels).collect()
    assert {(r["depth"], r["text"]) for r in out} == {(i, str(i)) for i in range(50)} | {(i + 1, f"side {i}") for i in range(49)}
    assert {r["num_replies"] for r in out if r["text"].isdigit() and r["depth"] < 49} == {2} and {r["post_id"] for r in out} == {"p"}


def test_replies_of_other_kinds(spark):
    tree = [{"id": "a", "body": "one", "replies": ""}, {"id": "b", "body": "two", "replies": None, "score": "7"}, {"id": "c", "body": 3},
            {"id": "d", "body": "x", "replies": [comment("e", "[removed]"), comment("f", "")]}, None, "odd"]
    out = flatten.flatten_comment_trees(spark.createDataFrame([("p", json.dumps(tree))], "id string, comments string")).collect()
    assert sorted((r["text"], r["num_replies"], r["likes"]) for r in out if r["text"] != "x") == [("3", 0, None), ("one", 0, None), ("two", 0, 7)]
    assert [(r["num_replies"], r["depth"]) for r in out if r["text"] == "x"] == [(2, 0)]


def test_prepare_small_tables(spark):
    a = [raw(spark, schemas.RAW_A, text=t, subreddit=s, created_utc=c, likes=l, num_replies=2, sentiment_polarity=p) for t, s, c, l, p in [
        ("Same text!", "one", "2024-03-04T05:06:07+00:00", 3, 0.5), ("https://only.link", "one", "bad", 0, 0.0), ("Other? text.", "two", "2023-01-01T00:00:00+00:00", -9, -0.7)]]
    b = [raw(spark, schemas.RAW_B, text=t, video_channel=None) for t in ("Same text!", "New cats text 42")]
    frame_a = spark.createDataFrame(a, schemas.RAW_A).withColumn("seq", F.monotonically_increasing_id())
    frame_b = spark.createDataFrame(b, schemas.RAW_B).withColumn("seq", F.monotonically_increasing_id()).drop("sentiment_label")
    lemma = spark.createDataFrame([("cats", "cat")], "form string, lemma string")
    out = {r["text"]: r for r in prepare.prepare(frame_a, frame_b, "seq", lemma_table=lemma).collect()}
    assert set(out) == {"Same text!", "Other? text.", "New cats text 42"}
    same, other, new = out["Same text!"], out["Other? text."], out["New cats text 42"]
    assert same["source"] == vocab.PLATFORM_A and same["community_size"] == 2
    assert (same["exclamation_count"], same["day_of_week"], same["hour"], same["engagement_score"]) == (1, 0, 5, 7)
    assert (other["engagement_score"], other["engagement_log"], other["is_negative"], other["question_count"]) == (-5, None, 1, 1)
    assert (new["community_size"], new["text_tfidf"], new["sentiment_label"], new["text_bert"]) == (None, "new cat text", "positive", "New cats text 42")
    assert sorted(prepare.prepare(frame_a, frame_b, "seq").columns) == sorted(schemas.FINAL_COLUMNS)


LEXICON = [("love", 3.2), ("hate", -2.7)]
GOOD = "I think AI is something I love and it would change the future of every job"


def test_collect_platform_a(spark):
    def post(i, rank, created, title, bodies, **more):
        return {"id": i, "title": title, "selftext": GOOD, "subreddit": "s", "score": 1, "upvote_ratio": 0.5, "num_comments": 9,
                "created_utc": created, "is_self": True, "comments": [comment(f"{i}{j}", b) for j, b in enumerate(bodies)], "community_rank": rank, **more}
    keep = [GOOD + f" number {n}" for n in range(3)]
    posts = [
        post("new", 0, 1.70e9, "a", keep), post("old", 0, 1.60e9, "b", keep + ["too short"]), post("late", 1, 1.71e9, "c", keep),
        post("link", 0, 1.70e9, "d", keep, is_self=False), post("early", 0, 1.0e9, "e", keep), post("quiet", 0, 1.7e9, "f", keep, num_comments=4),
    ]
    path = scratch_path(spark, "t")
    spark.createDataFrame([(json.dumps(p),) for p in posts], "value string").write.text(path)
    frame = spark.read.schema(schemas.POSTS + ", community_rank int").json(path)
    lexicon = spark.createDataFrame(LEXICON, "token string, valence double")
    out = collect.collect_platform_a(frame, lexicon, target=5).collect()
    assert sorted({r["post_id"] for r in out}) == ["new", "old"] and len(out) == 6
    first = out[0]
    assert first["sentiment_label"] == "positive" and first["contains_ai"] and first["comment_length"] == len(first["text"].split())
    assert set(c.split()[0] for c in schemas.RAW_A.split(", ")) <= set(out[0].asDict())


def test_collect_platform_b(spark):
    lexicon = spark.createDataFrame(LEXICON, "token string, valence double")
    threads = spark.createDataFrame([(f"{v}{i}", v, i, GOOD + f" {i}" if ok else "short") for v, ok in (("v1", True), ("v2", False), ("v3", True), ("v4", True)) for i in range(4)],
                                    "comment_id string, video_id string, position int, raw_text string")
    videos = spark.createDataFrame([("q", "v1", 0, 50), ("q", "v2", 1, 50), ("q", "v3", 2, 9), ("q", "v4", 3, 50)], "query string, video_id string, position int, video_comment_count long")
    out = collect.collect_platform_b(threads, videos, lexicon, videos_per_query=2, comments_per_video=3).collect()
    assert sorted({r["video_id"] for r in out}) == ["v1", "v4"] and len(out) == 6
