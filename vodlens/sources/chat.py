"""Chat sources: replay files, IRC lines and platform payloads, all to one chat schema.

Each normaliser is a projection over a column of wire text, so it runs the same in batch and stream.
Texts that cannot be read give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vodlens.functions import columns as C

EMOTE = "struct<id:string,name:string,count:bigint>"
CHAT = ["message_id", "timestamp_offset", "user_id", "author_name", "content", "emotes", "badges", "metadata"]

PERSON = "struct<_id:string,id:string,display_name:string,name:string>"
MESSAGE = "struct<body:string,fragments:array<struct<text:string,emoticon_id:string,id:string>>>"
COMMENT = f"struct<_id:string,message_id:string,content_offset_seconds:double,time_in_seconds:double,commenter:{PERSON},author:{PERSON},message:string,emotes:array<{EMOTE}>>"


def filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def replay(texts: DataFrame, column: str = "value") -> DataFrame:
    """Chat replay documents (a list, or {comments: [...]}): one row per comment."""
    t = F.col(column)
    wrapped = F.when(F.ltrim(t).startswith("["), F.concat(F.lit('{"comments":'), t, F.lit("}"))).otherwise(t)
    rows = texts.select(F.from_json(wrapped, f"comments array<{COMMENT}>").alias("d"))
    rows = rows.select(F.posexplode("d.comments").alias("place", "c"))
    structured = F.from_json("c.message", MESSAGE)
    is_object = F.ltrim("c.message").startswith("{")
    who = lambda name: filled(F.col(f"c.commenter.{name}"), F.col(f"c.author.{name}"))
    pieces = F.filter(structured["fragments"], lambda f: filled(f["emoticon_id"], f["id"]).isNotNull())
    emotes = F.transform(pieces, lambda f: F.struct(filled(f["emoticon_id"], f["id"]).alias("id"), f["text"].alias("name"), F.lit(1).cast("bigint").alias("count")))
    return rows.select(
        filled(F.col("c._id"), F.col("c.message_id"), F.concat(F.lit("msg_"), "place")).alias("message_id"),
        F.coalesce("c.content_offset_seconds", "c.time_in_seconds", F.lit(0.0)).alias("timestamp_offset"),
        F.coalesce(filled(F.col("c.commenter._id"), F.col("c.commenter.id"), F.col("c.author._id"), F.col("c.author.id")), F.lit("anon")).alias("user_id"),
        F.coalesce(filled(who("display_name"), who("name")), F.lit("Anonymous")).alias("author_name"),
        F.coalesce(F.when(is_object, structured["body"]).otherwise(F.col("c.message")), F.lit("")).alias("content"),
        F.coalesce(F.when(is_object, emotes).otherwise(F.col("c.emotes")), F.array().cast(f"array<{EMOTE}>")).alias("emotes"),
        F.array().cast("array<string>").alias("badges"),
        F.lit(None).cast("string").alias("metadata"),
    )


def read_replay(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Files of one document each, or (lines) of a document in each line."""
    return replay(spark.read.text(path, wholetext=not lines))


def irc(lines: DataFrame, column: str = "value") -> DataFrame:
    """IRCv3 lines: raw_line, tags (map), prefix, command, params, trailing; malformed lines go."""
    line = F.btrim(F.col(column), F.lit("\r\n"))
    tagged = line.startswith("@")
    raw_tags = F.when(tagged, F.regexp_extract(line, r"^@(\S*) ", 1))
    rest = F.ltrim(F.when(tagged, F.regexp_replace(line, r"^@\S* ", "")).otherwise(line))
    prefixed = rest.startswith(":")
    body = F.ltrim(F.when(prefixed, F.regexp_replace(rest, r"^:\S* ", "")).otherwise(rest))
    head = F.when(F.contains(body, F.lit(" :")), F.regexp_extract(body, r"^(.*?) :", 1)).otherwise(body)
    tokens = C.words(head)
    raw = F.transform_values(F.str_to_map(raw_tags, F.lit(";"), F.lit("=")), lambda k, v: F.coalesce(v, F.lit("")))

    def plain(v: Column) -> Column:
        for escaped, real in ((r"\:", ";"), (r"\s", " "), (r"\\", "\\"), (r"\r", "\r"), (r"\n", "\n")):
            v = F.replace(v, F.lit(escaped), F.lit(real))
        return v

    rows = lines.select(
        line.alias("raw_line"),
        F.coalesce(F.transform_values(raw, lambda k, v: plain(v)), F.create_map().cast("map<string,string>")).alias("tags"),
        F.when(prefixed, F.regexp_extract(rest, r"^:(\S*) ", 1)).alias("prefix"),
        F.upper(F.get(tokens, F.lit(0))).alias("command"),
        F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))).alias("params"),
        F.when(F.contains(body, F.lit(" :")), F.regexp_extract(body, r"(?s)^.*? :(.*)$", 1)).alias("trailing"),
        (tagged & ~F.contains(line, F.lit(" "))).alias("broken"),
        (prefixed & ~F.contains(rest, F.lit(" "))).alias("broken_prefix"),
    )
    return rows.where(F.col("command").isNotNull() & ~F.col("broken") & ~F.col("broken_prefix")).drop("broken", "broken_prefix")


def twitch(parsed: DataFrame, stream_start_ms: float | None = None) -> DataFrame:
    """Chat messages from parsed IRC lines (PRIVMSG)."""
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    content = F.coalesce("trailing", F.lit(""))
    author = F.coalesce(filled(tag("display-name"), F.regexp_extract("prefix", r"^([^!]*)", 1)), F.lit("Anonymous"))
    sent = tag("tmi-sent-ts").try_cast("double")
    offset = F.greatest(F.lit(0.0), (sent - stream_start_ms) / 1000) if stream_start_ms else sent / 1000
    groups = F.filter(F.split(F.coalesce(tag("emotes"), F.lit("")), "/"), lambda g: F.contains(g, F.lit(":")))

    def emote(g: Column) -> Column:
        spans = F.split(F.split_part(g, F.lit(":"), F.lit(2)), ",")
        first = F.get(spans, F.lit(0))
        a, b = F.split_part(first, F.lit("-"), F.lit(1)).try_cast("int"), F.split_part(first, F.lit("-"), F.lit(2)).try_cast("int")
        name = F.when(a.isNotNull() & b.isNotNull(), F.substring(content, a + 1, b - a + 1)).otherwise(F.split_part(g, F.lit(":"), F.lit(1)))
        return F.struct(F.split_part(g, F.lit(":"), F.lit(1)).alias("id"), name.alias("name"), F.size(spans).cast("bigint").alias("count"))

    bits = tag("bits").try_cast("double")
    meta = F.to_json(F.struct(F.lit("TWITCH").alias("platform"), tag("color").alias("user_color"), F.when(bits.isNotNull(), F.struct(F.lit("BITS").alias("type"), bits.alias("amount"), F.lit("BITS").alias("currency"))).alias("monetization")))
    return parsed.where("command = 'PRIVMSG'").select(
        F.coalesce(filled(tag("id")), F.sha2("raw_line", 256)).alias("message_id"), F.coalesce(offset, F.lit(0.0)).alias("timestamp_offset"),
        F.coalesce(filled(tag("user-id")), F.lower(author)).alias("user_id"), author.alias("author_name"), content.alias("content"),
        F.transform(groups, emote).alias("emotes"),
        F.filter(F.transform(F.split(F.coalesce(tag("badges"), F.lit("")), ","), lambda b: F.trim(b)), lambda b: b != "").alias("badges"), meta.alias("metadata"),
    )


def kick(payloads: DataFrame, column: str = "value", stream_start_ms: float = 0.0) -> DataFrame:
    """Chat messages from Kick message payloads; inline emotes are counted by id."""
    schema = "id string, content string, message string, user_id string, created_at string, chatroom_id bigint, type string, sender struct<id:string,username:string,slug:string,identity:struct<badges:array<struct<type:string,count:bigint>>>>, _bad string"
    d = payloads.select(F.col(column).alias("raw"), F.from_json(column, schema, {"columnNameOfCorruptRecord": "_bad"}).alias("d")).where("d is not null and d._bad is null")
    content = F.coalesce(filled(F.col("d.content"), F.col("d.message")), F.lit(""))
    found = F.regexp_extract_all(content, F.lit(r"\[emote:(\d+:[a-zA-Z0-9_]+)\]"), F.lit(1))
    ids = F.array_distinct(F.transform(found, lambda x: F.split_part(x, F.lit(":"), F.lit(1))))
    own = lambda i: F.filter(found, lambda x: F.split_part(x, F.lit(":"), F.lit(1)) == i)
    emotes = F.transform(ids, lambda i: F.struct(i.alias("id"), F.split_part(F.element_at(own(i), -1), F.lit(":"), F.lit(2)).alias("name"), F.size(own(i)).cast("bigint").alias("count")))
    number = F.col("d.created_at").try_cast("double")
    when = F.coalesce(F.when(number > 1e11, number / 1000).otherwise(number), F.unix_micros(F.try_to_timestamp("d.created_at")) / 1e6)
    badges = F.transform("d.sender.identity.badges", lambda b: F.when(b["count"].isNotNull(), F.concat_ws("/", b["type"], b["count"].cast("string"))).otherwise(b["type"]))
    return d.select(
        F.coalesce(filled(F.col("d.id")), F.sha2("raw", 256)).alias("message_id"), F.greatest(F.lit(0.0), F.coalesce(when - stream_start_ms / 1000, F.lit(0.0))).alias("timestamp_offset"),
        F.coalesce(filled(F.col("d.sender.id"), F.col("d.user_id")), F.lit("kick_anon")).alias("user_id"),
        F.coalesce(filled(F.col("d.sender.username"), F.col("d.sender.slug")), F.lit("Anonymous")).alias("author_name"), content.alias("content"), emotes.alias("emotes"),
        F.coalesce(F.filter(badges, lambda b: b != ""), F.array().cast("array<string>")).alias("badges"),
        F.to_json(F.struct(F.lit("KICK").alias("platform"), F.col("d.chatroom_id").alias("chatroom_id"), F.col("d.type").alias("kick_message_type"))).alias("metadata"),
    )


def youtube(items: DataFrame, column: str = "value", stream_start_ms: float = 0.0) -> DataFrame:
    """Chat messages from YouTube items: plain or run-list messages, emoji as text, Super Chat amounts."""
    run = "struct<text:string,emoji:struct<emoji_id:string,id:string,shortcuts:array<string>>>"
    schema = f"message_id string, id string, message string, time_in_seconds double, timestamp double, author struct<id:string,channel_id:string,name:string,display_name:string,badges:array<struct<title:string,label:string,type:string>>>, money struct<amount:double,currency:string>, _bad string"
    d = items.select(F.col(column).alias("raw"), F.from_json(column, schema, {"columnNameOfCorruptRecord": "_bad"}).alias("d")).where("d is not null and d._bad is null")
    runs = F.when(F.ltrim("d.message").startswith("["), F.from_json("d.message", f"array<{run}>"))
    emoji = lambda r: F.coalesce(F.get(r["emoji"]["shortcuts"], F.lit(0)), F.lit(":emoji:"))
    text = F.array_join(F.transform(runs, lambda r: F.coalesce(r["text"], emoji(r))), "")
    content = F.coalesce(text, F.when(F.ltrim("d.message").startswith("{"), F.get_json_object("d.message", "$.text")), F.col("d.message"), F.lit(""))
    emotes = F.transform(F.filter(runs, lambda r: r["emoji"].isNotNull() & r["text"].isNull()), lambda r: F.struct(F.coalesce(filled(r["emoji"]["emoji_id"], r["emoji"]["id"]), F.lit("yt_emoji")).alias("id"), emoji(r).alias("name"), F.lit(1).cast("bigint").alias("count")))
    name = F.coalesce(filled(F.col("d.author.name"), F.col("d.author.display_name")), F.lit("Anonymous"))
    offset = F.coalesce(F.col("d.time_in_seconds"), C.epoch_seconds(F.col("d.timestamp")) - stream_start_ms / 1000, F.lit(0.0))
    money = F.when(F.col("d.money.amount").isNotNull(), F.struct(F.lit("SUPERCHAT").alias("type"), "d.money.amount", "d.money.currency"))
    return d.select(
        F.coalesce(filled(F.col("d.message_id"), F.col("d.id")), F.sha2("raw", 256)).alias("message_id"), F.greatest(F.lit(0.0), offset).alias("timestamp_offset"),
        F.coalesce(filled(F.col("d.author.id"), F.col("d.author.channel_id")), F.lower(name)).alias("user_id"), name.alias("author_name"), content.alias("content"),
        F.coalesce(emotes, F.array().cast(f"array<{EMOTE}>")).alias("emotes"),
        F.coalesce(F.filter(F.transform("d.author.badges", lambda b: filled(b["title"], b["label"], b["type"])), lambda b: b.isNotNull()), F.array().cast("array<string>")).alias("badges"),
        F.to_json(F.struct(F.lit("YOUTUBE_LIVE").alias("platform"), money.alias("monetization"))).alias("metadata"),
    )


NORMALISERS = {"TWITCH": lambda df, **o: twitch(irc(df), **o), "KICK": kick, "YOUTUBE_LIVE": youtube, "REPLAY": replay}


def normalise(platform: str, texts: DataFrame, **options) -> DataFrame:
    """Chat messages of any registered platform; more can be added to NORMALISERS."""
    if platform not in NORMALISERS:
        raise ValueError(f"no chat normaliser for {platform}")
    return NORMALISERS[platform](texts, **options)
