"""Text functions as columns: Unicode tampering, encodings, labels, digests. Arrow UDFs only where Spark has no built-in."""

from __future__ import annotations

import base64
import codecs
import html
import itertools
import re
import unicodedata
from collections import Counter
from urllib.parse import unquote_to_bytes

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import ArrayType, StringType

MOST_INSPECTED, MOST_DECODED, MOST_LAYERS = 200_000, 100_000, 3
ZERO_WIDTH = "​‌‍⁠﻿᠎­͏"
BIDI = "‪‫‬‭‮⁦⁧⁨⁩"
_LOOKS = {"cyrillic": ("аеорсухіјһАВЕКМНОРСТХІЅ", "aeopcyxijhABEKMHOPCTXIS"), "greek": ("οαερυΟΑΒΕΖΗΙΚΜΝΡΤΧ", "oaepuOABEZHIKMNPTX")}
HOMOGLYPHS, LATIN = ("".join(x[k] for x in _LOOKS.values()) for k in (0, 1))
#: English words whose number tells a rotated text from a plain one.
FREQUENT = frozenset(
    "above act all and are assistant can disregard email for from have ignore instructions not now output password please pretend previous print prompt reveal role send system that the this user will with you your".split()
)
#: What str.isspace() calls white space, as a class body for java.util.regex.
WS = r"\t-\r\x1c-\x20\x85\xa0  -     　"
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: One such character, for java.util.regex: ASCII is told apart first, as a class of many ranges tries them all in turn.
SPACE = rf"[\t-\r\x1c-\x20[\x{{80}}-\x{{10ffff}}&&[{WS}]]]"
#: A text with anything but white space.
NONBLANK = rf"[^{WS}]"
ASCII_LOWER, ASCII_UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Label spellings of public data sets.
BENIGN = "0 benign clean false legitimate negative no normal not_injection safe valid"
MALICIOUS = "1 adversarial attack harmful injection jailbreak malicious positive prompt_injection true unsafe yes"


def _plain_points(most: int = 0x250, others: str = "‐‑‒–—―‘’‚‛“”„‟†‡•€") -> str:
    """Class body of the characters that normalisation leaves alone: stable under NFKC, and Latin if they are letters."""
    stable = lambda c: unicodedata.normalize("NFKC", c) == c and (not c.isalpha() or unicodedata.name(c, "").startswith("LATIN"))
    points = [k for k in [*range(most), *sorted(map(ord, others))] if stable(chr(k)) and chr(k) not in ZERO_WIDTH]
    runs: list[list[int]] = []
    for k in points:
        if runs and runs[-1][1] == k - 1:
            runs[-1][1] = k
        else:
            runs.append([k, k])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs)


#: Texts without such a character are their own NFKC and NFC, hold nothing invisible and no look-alikes, and are of Latin script.
#: All of ASCII is plain, so the many ranges are tried for other characters only.
UNUSUAL = rf"[\x{{80}}-\x{{10ffff}}&&[^{_plain_points()}]]"


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def stripped(c: Column) -> Column:
    """Without white space at both ends, by Python's notion of it."""
    return F.btrim(c, F.lit(BLANKS))


def truncated(c: Column, most: int | None = MOST_INSPECTED) -> Column:
    """A text as far as it is inspected; whole if `most` is None."""
    return c if most is None else F.substring(c, 1, most)


def without_zero_width(c: Column) -> Column:
    return F.translate(c, ZERO_WIDTH, "")


def without_bidi(c: Column) -> Column:
    return F.translate(c, BIDI, "")


def folded(c: Column) -> Column:
    """Cyrillic and Greek look-alikes as the Latin letters they look like."""
    return F.translate(c, HOMOGLYPHS, LATIN)


def rot13(c: Column) -> Column:
    turn = lambda s: s[13:] + s[:13]
    return F.translate(c, ASCII_LOWER + ASCII_UPPER, turn(ASCII_LOWER) + turn(ASCII_UPPER))


def english_words(c: Column) -> Column:
    """How many runs of a-z are frequent English words."""
    return F.size(F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1)), lambda w: w.isin(sorted(FREQUENT))))


def special_share_high(c: Column, most: float = 0.35) -> Column:
    """Whether over a third of a text of 20 characters or more are neither letters, digits nor white space."""
    return (F.length(c) >= 20) & (F.length(F.regexp_replace(c, rf"[\p{{L}}\p{{N}}{WS}]+", "")) / F.length(c) > most)


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def _unescaped_nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", html.unescape(x)))


def nfkc(c: Column) -> Column:
    """NFKC; only texts that it may change go to Python."""
    return F.coalesce(_nfkc(F.when(c.rlike(UNUSUAL), c)), c)


def script_of(text: str) -> tuple[str | None, bool]:
    """(dominant script, whether another holds over 5 %), by the first word of each letter's Unicode name."""
    counts: Counter = Counter()
    for letter, n in Counter(x for x in text if x.isalpha()).items():
        counts[unicodedata.name(letter, "unknown").split()[0].lower()] += n
    if not counts:
        return None, False
    most = max(counts.values())
    leaders = {k for k, n in counts.items() if n == most}
    top = next(iter(leaders)) if len(leaders) == 1 else next(k for x in text if x.isalpha() and (k := unicodedata.name(x, "unknown").split()[0].lower()) in leaders)
    return top, any(k != top and n / counts.total() > 0.05 for k, n in counts.items())


#: Rows of a batch that are Python objects at a time.
SLICE = 64


def sliced(rows: int):
    return ((at, min(SLICE, rows - at)) for at in range(0, rows, SLICE))


def arrow_lists(texts: pa.Array, kind: pa.DataType, each) -> pa.Array:
    """`each` of every text of lists of texts, null for null texts and null lists. SLICE texts are Python objects at a time."""
    every = texts.flatten()
    flat = pa.concat_arrays([pa.array([], kind), *(pa.array([None if x is None else each(x) for x in every.slice(at, n).to_pylist()], kind) for at, n in sliced(len(every)))])
    n = pc.fill_null(pc.list_value_length(texts), 0).to_pylist()
    at = pa.array([0, *itertools.accumulate(n)], pa.int32())
    return pa.ListArray.from_arrays(at, flat, mask=texts.is_null() if texts.null_count else None)


_UNICODE = pa.struct([("script", pa.string()), ("mixed", pa.bool_()), ("normal", pa.string())])
_INVISIBLE = str.maketrans("", "", ZERO_WIDTH + BIDI)


@F.arrow_udf(ArrayType(from_arrow_type(_UNICODE)))
def unicode_of(texts: pa.Array) -> pa.Array:
    """Of every text of an array: script, whether scripts are mixed, and NFKC of it without invisible characters."""

    def each(x: str) -> dict:
        script, mixed = script_of(x)
        return {"script": script, "mixed": mixed, "normal": unicodedata.normalize("NFKC", x.translate(_INVISIBLE))}

    return arrow_lists(texts, _UNICODE, each)


def readable(text: str) -> bool:
    n = len(text)
    return n >= 4 and (text.isprintable() or sum(x.isprintable() or x.isspace() for x in text) >= 0.9 * n) and sum(map(str.isalpha, text)) >= 3


_RUNS = {"base64_decoded": re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), "hex_decoded": re.compile(r"(?:[0-9A-Fa-f]{2}){8,}"), "url_encoded_decoded": re.compile(r"(?:%[0-9A-Fa-f]{2}){4,}")}
#: No run is shorter, and none holds white space.
_LEAST_RUN = 12
_LETTERS = re.compile("[a-z]+")
_TURNED = frozenset(codecs.encode(w, "rot13") for w in FREQUENT)
#: Characters beyond ASCII whose lower case holds an ASCII letter: rotation leaves them alone.
_ODD_LOWER = re.compile("[\u0130\u212a]")


def _bytes_of(kind: str, run: str) -> str | None:
    try:
        if kind == "base64_decoded":
            whole = run[: len(run) // 4 * 4]
            return base64.b64decode(whole, validate=True).decode() if len(whole) >= 16 else None
        if kind == "hex_decoded":
            return bytes.fromhex(run).decode()
        return unquote_to_bytes(run).decode("utf-8", "replace")
    except ValueError:
        return None


def layer(text: str) -> list[tuple[str, str]]:
    """(decoded text, flag) of every encoded run of a text, then the text rotated if that reads more like English."""
    long = " ".join([w for w in text.split() if len(w) >= _LEAST_RUN])
    out = [(got, kind) for kind, runs in _RUNS.items() for run in runs.findall(long) if (got := _bytes_of(kind, run)) is not None and readable(got)]
    words = _LETTERS.findall(text.lower())
    if odd := _ODD_LOWER.search(text):
        turned = _LETTERS.findall(codecs.encode(text, "rot13").lower())
    score = lambda ws, table: sum(map(table.__contains__, ws))
    if (score(turned, FREQUENT) if odd else score(words, _TURNED)) > score(words, FREQUENT):
        out.append((codecs.encode(text, "rot13"), "rot13_decoded"))
    return out


def unwrapped(text: str, most: int = MOST_DECODED) -> tuple[list[str], list[str]]:
    """(variants, flags): what up to MOST_LAYERS of encodings hide, breadth first, until `most` characters are passed."""
    variants: dict[str, None] = {}
    flags: dict[str, None] = {}
    budget, now = most, [text]
    for _ in range(MOST_LAYERS):
        found: list[str] = []
        for got, flag in (x for t in now for x in layer(t)):
            if got == text or got in variants:
                continue
            budget -= len(got)
            if budget < 0:
                return list(variants), list(flags | {"oversized_after_decode": None})
            variants[got] = flags[flag] = None
            found.append(got)
        now = found
        if not now:
            return list(variants), list(flags)
    return list(variants), list(flags | {"decode_depth_exceeded": None})


_DECODED = pa.struct([("variants", pa.list_(pa.string())), ("flags", pa.list_(pa.string()))])
_ROTATED = sorted(codecs.encode(w, "rot13") for w in FREQUENT)
_RUN = "(?<![a-z])(?:{})(?![a-z])"


@F.arrow_udf(ArrayType(from_arrow_type(_DECODED)))
def decoded(texts: pa.Array) -> pa.Array:
    """unwrapped() of every text of an array."""
    return arrow_lists(texts, _DECODED, lambda x: dict(zip(("variants", "flags"), unwrapped(x))))


def encoded(c: Column) -> Column:
    """Whether decoding may find anything: an encoded run, or more words that are English when rotated than now."""
    count = lambda words: F.regexp_count(F.lower(c), F.lit(_RUN.format("|".join(words))))
    rotated = _RUN.format("|".join(_ROTATED))
    # runs are tried from their beginnings only
    return c.rlike(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{16}") | (c.contains("%") & c.rlike(r"(?:%[0-9A-Fa-f]{2}){4}")) | (F.lower(c).rlike(rotated) & (count(_ROTATED) > count(sorted(FREQUENT))))


def collapsed(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return stripped(F.regexp_replace(c, f"{SPACE}+", " "))


def near_key(c: Column, ascii_only: bool = False) -> Column:
    """What near-identical texts share: NFKC, lower case, words only. ascii_only leaves out the UDF, for ASCII texts."""
    # white space is neither a letter, a digit nor '_', so one class takes it and the signs
    return stripped(F.regexp_replace(F.lower(c if ascii_only else nfkc(c)), r"[^\p{L}\p{N}_]+", " "))


def clean_text(c: Column, ascii_only: bool = False) -> Column:
    """Entities resolved, NFC, control characters and stray white space removed; wording, case and signs stay."""
    x = c if ascii_only else F.coalesce(_unescaped_nfc(F.when(c.contains("&") | c.rlike(UNUSUAL), c)), c)
    x = F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")
    x = F.regexp_replace(x, r"\r\n?", "\n")
    x = F.regexp_replace(x, r"[ \t]+(?=\n|\z)", "")
    x = F.regexp_replace(x, r"[ \t]{2,}", " ")
    return stripped(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def label_of(c: Column) -> Column:
    """0 or 1 of any spelling of a label; numbers are cut to whole ones; null for what isn't one."""
    word = F.lower(stripped(c.cast("string")))
    return F.when(word.isin(BENIGN.split()), 0).when(word.isin(MALICIOUS.split()), 1)


def number_label(c: Column) -> Column:
    whole = F.when(~F.isnan(c.cast("double")), c.cast("double").cast("long"))
    return F.when(whole.isin(0, 1), whole.cast("int"))


def estimated_tokens(c: Column) -> Column:
    return F.when(F.length(c) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(c) / 4))).cast("int")


def payload(c: Column, with_content: bool = False) -> Column:
    """Length, token estimate and SHA-256 of a payload, and the payload itself only on demand."""
    return F.struct(F.length(c).alias("length"), estimated_tokens(c).alias("tokens"), F.sha2(c, 256).alias("sha256"), (c if with_content else F.lit(None).cast("string")).alias("content"))


def iso_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
