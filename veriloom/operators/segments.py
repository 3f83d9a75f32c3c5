"""Requests to text segments, each with its source, origin and trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import markup
from veriloom.functions import text as T

#: Context tags in the order in which segments come; the order breaks ties.
TAGS = ("user_input", "retrieved_document", "web_content", "api_response", "system_prompt")
TRUST = {"system_prompt": "trusted", "user_input": "semi_trusted", "retrieved_document": "untrusted", "web_content": "untrusted", "api_response": "untrusted", "assistant_output": "untrusted"}
CLASSES = {"trusted": "n/a", "semi_trusted": "direct", "untrusted": "indirect"}
ROLES = {"system": "system_prompt", "developer": "system_prompt", "user": "user_input", "assistant": "assistant_output", "tool": "api_response", "function": "api_response"}
BLOCK = "struct<type:string,text:string>"
MESSAGES = f"array<struct<role:string,content:string,blocks:array<{BLOCK}>>>"
CONTEXT = "struct<" + ",".join(f"{t}:string" for t in TAGS) + ">"
REQUEST = f"request_id string, ord long, session_id string, model string, stream boolean, messages {MESSAGES}, context {CONTEXT}"
DEFAULT_MODEL = "default"


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def trust_of(tag: Column) -> Column:
    return F.coalesce(lookup(TRUST, tag), F.lit("untrusted"))


def class_of(tag: Column) -> Column:
    return lookup(CLASSES, trust_of(tag))


def is_untrusted(tag: Column) -> Column:
    return trust_of(tag) == "untrusted"


def tag_of_role(role: Column) -> Column:
    return F.coalesce(lookup(ROLES, F.lower(role)), F.lit("user_input"))


def content_text(m: Column) -> Column:
    """A message's text: its content, or its text blocks by line."""
    texts = F.transform(F.filter(m["blocks"], lambda b: b["text"].isNotNull()), lambda b: b["text"])
    return F.coalesce(m["content"], F.array_join(texts, "\n"), F.lit(""))


def _segment(tag: Column, origin: Column, text: Column) -> Column:
    return F.struct(tag.alias("source_tag"), origin.alias("origin"), text.alias("raw_text"))


def of_context(context: Column) -> Column:
    every = F.array(*[_segment(F.lit(t), F.lit(f"context.{t}"), context[t]) for t in TAGS])
    return F.filter(every, lambda s: s["raw_text"].isNotNull())


def of_messages(messages: Column) -> Column:
    every = F.transform(messages, lambda m, i: _segment(tag_of_role(m["role"]), F.concat(F.lit("messages["), i.cast("string"), F.lit("]")), content_text(m)))
    return F.filter(every, lambda s: s["raw_text"].rlike(T.NONBLANK))


def segment_array(context: Column, messages: Column) -> Column:
    """A request's segments: its context's if it has one, else its messages'."""
    none = F.array().cast("array<struct<source_tag:string,origin:string,raw_text:string>>")
    return F.coalesce(F.when(context.isNotNull(), of_context(context)).otherwise(of_messages(messages)), none)


def segments(requests: DataFrame) -> DataFrame:
    """A row for each segment of requests: request_id, seg_idx, source_tag, origin, trust, injection_class, raw_text."""
    rows = requests.select("request_id", F.posexplode(segment_array(F.col("context"), F.col("messages"))).alias("seg_idx", "s"))
    return rows.select("request_id", "seg_idx", "s.source_tag", "s.origin", trust_of(F.col("s.source_tag")).alias("trust"), class_of(F.col("s.source_tag")).alias("injection_class"), "s.raw_text")


def inspectable_text(context: Column, messages: Column) -> Column:
    """All of a request's text by line; empty texts keep their line."""
    return F.when(context.isNotNull(), F.array_join(of_context(context)["raw_text"], "\n")).otherwise(F.array_join(F.transform(messages, content_text), "\n"))


def upstream(requests: DataFrame) -> DataFrame:
    """What is forwarded: no session and no context, and a model in any case."""
    return requests.drop("session_id", "context").withColumn("model", F.coalesce("model", F.lit(DEFAULT_MODEL)))


def sample_requests(samples: DataFrame) -> DataFrame:
    """Labelled samples (ord, text, source_tag) as requests: a user message, with context unless the user is the source."""
    one = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"), F.lit(None).cast(f"array<{BLOCK}>").alias("blocks"))
    context = F.struct(*[F.when(F.col("source_tag") == t, F.col("text")).alias(t) for t in TAGS])
    return samples.withColumns(
        {
            "request_id": F.col("ord").cast("string"),
            "session_id": F.lit(None).cast("string"),
            "model": F.lit(DEFAULT_MODEL),
            "stream": F.lit(False),
            "messages": F.array(one),
            "context": F.when((F.col("source_tag") != "user_input") & F.col("source_tag").isin(*TAGS), context),
        }
    )


NORMALISED = "struct<text:string,variants:array<string>,flags:array<string>,script:string>"


def _cleaned(raw: Column, u: Column) -> Column:
    """One text with what unicode_of found in it, if anything is unusual: text, script and flags."""
    a = T.without_zero_width(raw)
    b = T.without_bidi(a)
    when = lambda cond, name: F.when(cond, F.lit(name))
    text = T.folded(u["normal"])
    flags = F.array(
        when(u["mixed"], "mixed_script_detected"),
        when(a != raw, "zero_width_chars_detected"),
        when(b != a, "bidi_control_chars_detected"),
        when(u["normal"] != b, "unicode_nfkc_applied"),
        when(text != u["normal"], "homoglyphs_normalized"),
    )
    usual = F.struct(raw.alias("text"), F.when(raw.rlike(r"\p{L}"), F.lit("latin")).alias("script"), F.array().cast("array<string>").alias("flags"))
    return F.when(u.isNull(), usual).otherwise(F.struct(text.alias("text"), u["script"].alias("script"), F.array_compact(flags).alias("flags")))


def normalised_each(df: DataFrame, texts: Column, most: int | None = T.MOST_INSPECTED) -> DataFrame:
    """df with `norm`: NORMALISED of every text of an array: cut, script, invisible characters, NFKC, look-alikes, encodings, signs.

    Only texts with an unusual character, and only those that may hide an encoding, have work for Python; a row stays one
    row. Null texts count as empty. `most`: characters inspected, None for all.
    """
    df = df.withColumn("_t", F.transform(texts, lambda t: F.coalesce(t, F.lit(""))))
    df = df.withColumn("_raw", F.transform("_t", lambda t: T.truncated(t, most)))
    df = df.withColumn("_u", T.unicode_of(F.transform("_raw", lambda t: F.when(t.rlike(T.UNUSUAL), t))))
    df = df.withColumn("_c", F.transform("_raw", lambda t, i: _cleaned(t, F.col("_u")[i])))
    df = df.withColumn("_dec", T.decoded(F.transform(F.col("_c")["text"], lambda t: F.when(T.encoded(t), t))))
    none = F.array().cast("array<string>")

    def joined(c: Column, i: Column) -> Column:
        d = F.col("_dec")[i]
        before = F.array(F.when(F.length(F.col("_t")[i]) > most, F.lit("truncated_for_inspection"))) if most else none
        after = F.array(F.when(T.special_share_high(c["text"]), F.lit("excessive_special_characters")))
        return F.struct(c["text"].alias("text"), F.coalesce(d["variants"], none).alias("variants"), F.array_compact(F.concat(before, c["flags"], F.coalesce(d["flags"], none), after)).alias("flags"), c["script"].alias("script"))

    return df.withColumn("norm", F.transform("_c", joined).cast(f"array<{NORMALISED}>")).drop("_t", "_raw", "_u", "_c", "_dec")


def plain_normalised(df: DataFrame, column: str = "raw_text", most: int | None = T.MOST_INSPECTED) -> DataFrame:
    """df with text, variants, flags, script of a text column, by normalised_each."""
    n = F.col("norm")[0]
    return normalised_each(df, F.array(column), most).withColumns({k: n[k] for k in ("text", "variants", "flags", "script")}).drop("norm")


def normalised_segments(df: DataFrame, segs: Column, most: int | None = T.MOST_INSPECTED) -> DataFrame:
    """df with `norm`: NORMALISED of every segment (source_tag, raw_text) of an array. A row stays one row.

    Only texts that look like HTML, from sources that may hold it, go to the parser; each of their channels is normalised
    by itself, and what they give is merged, visible text first.
    """
    is_html = lambda s: s["source_tag"].isin(*markup.MARKUP_TAGS) & markup.looks_like_html(F.coalesce(s["raw_text"], F.lit("")))
    df = df.withColumn("_segs", segs)
    df = df.withColumn("_html", markup.channels_of_each(F.transform("_segs", lambda s: F.when(is_html(s), s["raw_text"]))))

    def parts(s: Column, i: Column) -> Column:
        got = markup.pieces(F.col("_html")[i])
        return F.when(F.col("_html")[i].isNull(), F.array(s["raw_text"])).when(F.size(got) == 0, F.array(F.lit(""))).otherwise(got)

    df = df.withColumn("_parts", F.transform("_segs", parts))
    df = normalised_each(df.withColumn("_flat", F.flatten("_parts")), F.col("_flat"), most).withColumnRenamed("norm", "_norm")
    none = F.array().cast("array<string>")

    def merged(p: Column, i: Column) -> Column:
        start = F.aggregate(F.slice("_parts", F.lit(1), i), F.lit(0), lambda a, x: a + F.size(x))
        x = F.slice("_norm", start + 1, F.size(p))
        rest = F.flatten(F.transform(F.slice(x, 2, 1 << 30), lambda y: F.concat(F.array(y["text"]), y["variants"])))
        return F.struct(
            x[0]["text"].alias("text"),
            F.concat(x[0]["variants"], rest).alias("variants"),
            F.array_distinct(F.concat(F.coalesce(F.col("_html")[i]["flags"], none), F.flatten(x["flags"]))).alias("flags"),
            F.try_element_at(F.filter(x["script"], lambda s: s.isNotNull()), F.lit(1)).alias("script"),
        )

    return df.withColumn("norm", F.transform("_parts", merged).cast(f"array<{NORMALISED}>")).drop("_segs", "_html", "_parts", "_flat", "_norm")


def normalised(segs: DataFrame, most: int | None = T.MOST_INSPECTED) -> DataFrame:
    """segments(...) with text, variants, flags and script, by normalised_segments."""
    n = F.col("norm")[0]
    return normalised_segments(segs, F.array(F.struct("source_tag", "raw_text")), most).withColumns({k: n[k] for k in ("text", "variants", "flags", "script")}).drop("norm")


def scannable(text: Column, variants: Column) -> Column:
    """text and variants, without blanks and without those that equal an earlier one but for white space at the ends."""
    every = F.filter(F.concat(F.array(text), variants), lambda x: x.isNotNull() & x.rlike(T.NONBLANK))
    first = lambda e: F.filter(F.transform(e["x"], lambda x, i: F.when(F.array_position(e["k"], e["k"][i]) == i + 1, x)), lambda x: x.isNotNull())
    bound = lambda e: F.when(F.size(e) <= 1, e).otherwise(F.transform(F.array(F.struct(e.alias("x"), F.transform(e, T.stripped).alias("k"))), first)[0])
    return F.transform(F.array(every), bound)[0]


def combined(text: Column, variants: Column) -> Column:
    return F.array_join(F.concat(F.array(text), variants), "\n")
