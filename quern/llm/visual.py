"""One consistent form for texts that look the same.

The form is the composed compatibility normalisation of Unicode, narrowed to
what a reader can't see. Kept apart, though the standard normalisation joins
them: raised, lowered, circled and fractional signs, styled letters, old letter
shapes and free-standing accents. Beyond it: blanks become a space, line ends
a line feed, characters that show nothing go, and letters of the same shape
from other alphabets become the Latin one. Letter case is visible, so folding
it is an option that is off by default.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.bounded import bounded_join
from quern.operators.materialize import materialize

# Characters that show nothing (the ranges of Unicode's Default_Ignorable_Code_Point,
# control characters that neither break a line nor leave a blank, and annotation marks).
INVISIBLE = [
    (0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160),
    (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFFB), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A),
    (0xE0000, 0xE0FFF),
]

# Characters that end a line, beside the line feed.
LINE_ENDS = "\x0b\x0c\r\x85\u2028\u2029"

# For a Latin letter or sign, those of other alphabets (and free-standing small capitals) of the same shape.
SAME_SHAPE = {
    "A": "ΑАᎪꓮ𐊠", "B": "ΒВᏴꓐ𐊂", "C": "ϹСᏟⲤꓚ", "D": "Ꭰꓓ", "E": "ΕЕᎬⴹꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "ΗНᎻⲎꓧ",
    "I": "ΙІӀⲒꓲ", "J": "ͿЈᎫꓙ", "K": "ΚКᏦⲔꓗ", "L": "ԼᏞⳐꓡ", "M": "ΜϺМᎷⲘꓟ", "N": "ΝⲚꓠ", "O": "ΟОՕⲞⵔꓳ", "P": "ΡРᏢⲢꓑ",
    "Q": "Ԛⵕ", "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ", "T": "ΤТᎢⲦꓔ", "U": "Սꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳꓪ", "X": "ΧХⲬꓫ", "Y": "ΥУҮⲨꓬ", "Z": "ΖᏃꓜ",
    "a": "а", "c": "ϲсⲥꮯᴄ", "d": "ԁ", "e": "е", "g": "ցɡ", "h": "һհᏂ", "i": "і", "j": "ϳј", "l": "ӏ", "n": "ո", "o": "οоօⲟᴏ", "p": "ρрⲣ",
    "q": "ԛզգ", "s": "ѕꮪꜱ", "u": "սυ", "v": "νѵꮩᴠ", "w": "ԝѡꮃᴡ", "x": "хⲭ", "y": "уү", "z": "ꮓᴢ", "-": "‐‑", " ": "⠀",
}
LATIN = {other: letter for letter, others in SAME_SHAPE.items() for other in others}

# Characters that the standard normalisation joins with others of visibly different shape.
OTHER_SHAPE = "ſẛϐϑϒϕϖϰϱϴϵ№℀℁℅℆〶"

# Hangul letters that stand alone; joined with their neighbours they would become syllables.
LONE_HANGUL = (0x3131, 0x318E)

# Kinds of compatibility mapping that only change width, joining or line breaking.
UNSEEN_KINDS = {"<wide>", "<narrow>", "<small>", "<noBreak>", "<compat>", "<square>", "<initial>", "<medial>", "<final>", "<isolated>"}


@lru_cache(maxsize=1)
def form_table() -> dict[str, str]:
    """What becomes of each decomposed character that does not stay; built from the rules above in each Python worker."""
    table: dict[str, str] = {}

    def expanded(char: str) -> str:
        kind, _, rest = unicodedata.decomposition(char).partition(" ")
        if char in OTHER_SHAPE or LONE_HANGUL[0] <= ord(char) <= LONE_HANGUL[1] or (kind.startswith("<") and kind not in UNSEEN_KINDS) or not kind:
            return LATIN.get(char, char)
        points = rest if kind.startswith("<") else f"{kind} {rest}"
        parts = [chr(int(p, 16)) for p in points.split()]
        if kind.startswith("<") and parts[0] == " ":  # a free-standing accent
            return char
        return "".join(map(expanded, parts))

    for start, end in [(0x80, 0x33FF), (0xA000, 0xABFF), (0xF900, 0xFFFF), (0x10000, 0x1FFFF), (0x2F800, 0x2FA1F)]:
        for point in range(start, end + 1):
            char = chr(point)
            new = " " if unicodedata.category(char) == "Zs" else expanded(char)
            if new != char:
                table[char] = new
    table["\t"] = " "
    table |= dict.fromkeys(LINE_ENDS, "\n")
    for start, end in INVISIBLE:
        table |= {chr(point): "" for point in range(start, end + 1)}
    return table


@lru_cache(maxsize=1)
def _lookup() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table by code point: where each one's replacement begins in the pool, how long it is, and the pool."""
    points = sys.maxunicode + 1
    begin, size, more = np.arange(points, dtype=np.int32), np.ones(points, dtype=np.int32), []
    for char, new in form_table().items():
        begin[ord(char)], size[ord(char)] = points + len(more), len(new)
        more.extend(map(ord, new))
    return begin, size, np.concatenate([np.arange(points), more]).astype("<u4")


#: Stands between texts that are formed together; a noncharacter, which no rule touches.
BETWEEN = "\uffff"

#: Characters looked up at a time, and of texts that are formed together; they bound memory, not what is formed.
LOOKUP_CHARS, TOGETHER_CHARS = 1 << 18, 1 << 21


def _mapped(text: str) -> str:
    """Each character replaced by the table, for many characters at a time."""
    begin, size, pool = _lookup()
    points, out = np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), []
    for start in range(0, len(points), LOOKUP_CHARS):
        part = points[start : start + LOOKUP_CHARS]
        lengths = size[part]
        ends = np.cumsum(lengths)
        at = np.repeat(begin[part] - (ends - lengths), lengths) + np.arange(ends[-1])
        out.append(pool[at].tobytes().decode("utf-32-le"))
    return "".join(out)


def _formed(texts: Sequence[str]) -> list[str]:
    joined = BETWEEN.join(texts)
    if joined.count(BETWEEN) != len(texts) - 1:  # a text has the sign
        return [_formed([t])[0] for t in texts] if len(texts) > 1 else [_form(joined)]
    return _form(joined).split(BETWEEN)


def _form(text: str) -> str:
    return unicodedata.normalize("NFC", _mapped(unicodedata.normalize("NFD", text.replace("\r\n", "\n"))))


def visual_forms(texts: Sequence[str], fold_case: bool = False) -> list[str]:
    """The form of each text: equal for texts that look the same, different for all others.

    Texts are formed together, joined by a sign that none of them has. With
    ``fold_case`` texts that differ only in letter case become equal too. A
    text that shows nothing becomes empty or blank.
    """
    found, held, chars = list(texts), [], 0

    def settle() -> None:
        for i, form in zip(held, _formed([found[i] for i in held]), strict=True):
            found[i] = form
        held.clear()

    for i, text in enumerate(texts):
        if not (text.isascii() and text.isprintable()):
            held.append(i)
            chars += len(text)
            if chars >= TOGETHER_CHARS:
                settle()
                chars = 0
    if held:
        settle()
    if fold_case:
        found = [unicodedata.normalize("NFC", text.casefold()) for text in found]
    return found


def visual_form(text: str, fold_case: bool = False) -> str:
    """The form of one text."""
    return visual_forms([text], fold_case)[0]


def with_forms(df: DataFrame, identifier: str, text: str, fold_case: bool = False, keep_form: bool = True) -> DataFrame:
    """The form of each text: id, form (if kept), form_key and text_key (16-byte digests; form_key NULL: it shows nothing).

    Worked out once for each distinct text of a batch, on whole texts. A NULL
    text has a NULL form and keys; repeated rows stay repeated.
    """
    rows = df.select(F.col(f"`{identifier}`").alias("id"), F.col(f"`{text}`").alias("text"))
    fields = [T.StructField("form", T.StringType())] * keep_form + [T.StructField(c, T.BinaryType()) for c in ("form_key", "text_key")]
    schema = T.StructType([rows.schema.fields[0], *fields])

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda s: hashlib.blake2b(s.encode(), digest_size=16).digest()
        for batch in batches:
            if not batch.num_rows:
                continue
            distinct = pc.dictionary_encode(batch.column(1))
            if isinstance(distinct, pa.ChunkedArray):
                distinct = distinct.combine_chunks()
            texts = distinct.dictionary.to_pylist()
            found = visual_forms(texts, fold_case)
            form_keys = pa.array([digest(f) if f and not f.isspace() else None for f in found], pa.binary())
            out = [form_keys, pa.array(map(digest, texts), pa.binary())]
            if keep_form:
                out.insert(0, pa.array(found, pa.string()))
            yield pa.record_batch([batch.column(0), *(x.take(distinct.indices) for x in out)], schema.names)

    return rows.mapInArrow(forms, schema)


#: Documents of one text that go together.
CHUNK = 4096

#: Chunks of one form's texts that meet those of another block in one task.
BLOCK = 256


def alike_texts(forms: DataFrame) -> DataFrame:
    """The texts whose form has several: form_key, text_key, chunks (of its documents), and blocks of the form.

    Written to the shared folder.
    """
    shown = forms.filter("form_key IS NOT NULL AND id IS NOT NULL")
    texts = materialize(shown.groupBy("form_key", "text_key").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")))
    several = texts.groupBy("form_key").agg(F.count(F.lit(1)).alias("texts"), F.ceil(F.sum("chunks") / BLOCK).cast("int").alias("blocks")).filter("texts > 1").drop("texts")
    return materialize(bounded_join(texts, several, ["form_key"], ["text_key"]))


def alike_pairs(forms: DataFrame) -> DataFrame:
    """Pairs of documents with unequal texts of one form: id_a, id_b, the smaller first.

    Documents with equal texts make no pair with each other, and forms that
    only one text has take no part. The documents of a text go in chunks, the
    chunks of a form in blocks, and each pair of blocks is a task's work, so
    that no task holds a form or a text that many documents have. What is
    compared are chunks; only chunks of unequal texts are expanded.
    """
    texts = alike_texts(forms)
    docs = bounded_join(forms.filter("id IS NOT NULL").select("id", "form_key", "text_key"), texts, ["form_key", "text_key"], ["id"], written=True)
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk")
    chunks = docs.groupBy("form_key", "text_key", "blocks", chunk).agg(F.collect_set("id").alias("ids"))
    block = F.pmod(F.xxhash64("text_key", "chunk"), F.col("blocks")).cast("int")
    chunks = materialize(chunks.withColumn("block", block))

    def side(name: str, partner: Column) -> DataFrame:
        """Each chunk once for every block that it meets on this side, the lower block being on the left."""
        return chunks.select("form_key", F.col("text_key").alias(f"text_{name}"), F.col("ids").alias(f"ids_{name}"), "block", F.explode(partner).alias("partner"))

    left = side("a", F.sequence(F.col("block"), F.col("blocks") - 1)).withColumnsRenamed({"block": "low", "partner": "high"})
    right = side("b", F.sequence(F.lit(0), F.col("block"))).withColumnsRenamed({"block": "high", "partner": "low"})
    # within a block each pair of texts is met in both orders
    met = left.join(right, ["form_key", "low", "high"]).filter("(low < high AND text_a <> text_b) OR (low = high AND text_a < text_b)")
    full = met.select(F.explode("ids_a").alias("a"), "ids_b").select("a", F.explode("ids_b").alias("b"))
    return full.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).filter("id_a <> id_b").distinct()


def form_classes(forms: DataFrame) -> DataFrame:
    """Each document with its class: id, class_id (the smallest id of the form), texts (distinct ones in the class).

    Documents whose text shows nothing, or is NULL, are in no class.
    """
    rows = forms.filter("form_key IS NOT NULL")
    texts = rows.groupBy("form_key", "text_key").agg(F.min("id").alias("id"))
    classes = texts.groupBy("form_key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("texts"))
    return bounded_join(rows.select("id", "form_key"), classes, ["form_key"], ["id"]).select("id", "class_id", "texts")
