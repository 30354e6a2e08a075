"""Which charset were bytes written in?  Candidates are scored by how their letters go together.

Bytes with a byte-order mark need no guess, nor does valid UTF-8 without NUL
bytes, unless all it has beyond ASCII sticks to Latin letters and the bytes are
faultless letters in another charset.  Otherwise each candidate decodes the whole text strictly, and its letters are
scored for the languages it serves: letters that the language uses count for it,
those of other scripts by how frequent they are; other letters and signs count against it, and so do pairs
that do not occur inside words: a small letter before a capital, letters of two
scripts, a sign between letters, й after a consonant, a consonant that ends no
Greek word, and signs of numbers without a number.  Control characters rule a candidate out.  The
best candidate with a positive score wins, the earlier one of equals; without
one the bytes are no text.  Candidates that the bytes do not rule out are kept
with the evidence against them, for a folder's other files to tell.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from ..functions.text import by_parts
from .work import small_batches, work_path

# Letters of languages (of the scripts, frequent ones first) and their charsets.
LATIN = {
    "éèàêçùâîôûëïœæÿ": ("cp1252", "iso8859_15"),  # French
    "äöüß": ("cp1252",),  # German
    "áéíóúüñ": ("cp1252",),  # Spanish
    "ãáàâçéêíóôõúü": ("cp1252",),  # Portuguese
    "àèéìòù": ("cp1252",),  # Italian
    "åäöæøé": ("cp1252",),  # Nordic
    "ąćęłńóśźż": ("cp1250", "iso8859_2"),  # Polish
    "áčďéěíňóřšťúůýž": ("cp1250", "iso8859_2"),  # Czech
    "áéíóöőúüű": ("cp1250", "iso8859_2"),  # Hungarian
    "ăâîşţ": ("cp1250", "iso8859_2"),  # Romanian
    "čćđšž": ("cp1250", "iso8859_2"),  # Croatian
    "çğıöşüİ": ("cp1254",),  # Turkish
    "ąčęėįšųūž": ("cp1257",),  # Lithuanian
}
SCRIPTS = {
    "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё": ("cp1251", "koi8_r", "iso8859_5", "cp866", "mac_cyrillic"),  # Russian
    "оаинтевірслкдмузпяьбгчйхцжїюєщшфґ": ("cp1251", "koi8_u"),  # Ukrainian
    "αοιετσνηυρπκμλωάγδθχφβξζψςέόίήύώϊϋΐΰ": ("cp1253", "iso8859_7"),  # Greek
    "יוהלאתמרבשנכפעקדטסגחזצךםןףץ": ("cp1255", "iso8859_8"),  # Hebrew
    "اليمنرتوبهةعدسفكقحجشصطخذضزظغثءآأإئؤى": ("cp1256", "iso8859_6"),  # Arabic
}
WIDE = {
    "shift_jis": ("[぀-ヿ]", "[一-鿿々〆]"),
    "euc_jp": ("[぀-ヿ]", "[一-鿿々〆]"),
    "gb18030": ("[的一是不了在人有我他这中大来上个国和也子时道说出而要于就下得可你年生自会那后能对着]", "[一-鿿]"),
    "big5": ("[的一是不了在人有我他這中大來上個國和也子時道說出而要於就下得可你年生自會那後能對著]", "[一-鿿]"),
    "euc_kr": ("[가-힣]", "[一-鿿]"),
}
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
QUOTES = "½¼¾±²³µ×‘’“”„‚«»‹›–—…•§©®°·¡¿€£ºª 、。「」『』・ー！？（），：；《》"

#: What a capital counts against its small letter.
CAPITAL = 0.92
#: What letters of several western languages in one text count against those of one.
WESTERN = 0.8
#: Evidence against a charset that no folder outweighs.
REACH = 12.0
#: Tables of more rows than this are joined by a shuffle.
BROADCAST_ROWS = 100_000
CONTROL = "[\x00-\x08\x0e-\x1a\x1c-\x1f\x7f-\x9f\ue000-\uf8ff\ufffe\uffff]"
LETTER = r"[^\W\d_]"
BLOCKS = "A-Za-zÀ-ɏ|Ѐ-ӿ|Ͱ-Ͽ|֐-׿|؀-ۿ|぀-ヿ一-鿿|가-힣".split("|")

#: A vowel and a consonant side by side speak for a script that writes both.
VOWEL, CONSONANT = "(?i)[аеёиоуыэюяіїєαειουηωάέήίόύώ]", "(?i)[бвгджзйклмнпрстфхцчшщґβγδζθκλμνξπρσςτφχψ]"

#: Signs that want a number beside them.
NUMBERLESS = re.compile(r"(?<!\d)(?<!\d\s)[€£±](?!\s?[\d.,]*\d)")

#: Letters of other scripts stuck to Latin ones, each by itself.
STUCK = re.compile(f"(?<=[A-Za-z])[{''.join(BLOCKS[1:])}](?![^\\x00-\\x7f])|(?<![^\\x00-\\x7f])[{''.join(BLOCKS[1:])}](?=[A-Za-z])")
STUCK_PAIR = f"[A-Za-z][{''.join(BLOCKS[1:])}]|[{''.join(BLOCKS[1:])}][A-Za-z]"

#: Kinds of characters, a bit each.
KINDS = [
    "[a-zà-öø-ÿа-яёά-ώ]", "(?i)[бвгджзклмнпрстфхцчшщ]", VOWEL, CONSONANT,  # first ones of pairs
    LETTER,
    r"[^\w\s'’\-.,:;/&@+()\[\]\"!?…·「」『』、。・（）！？，：；—–“”«»]",  # signs that stand in no word
    r"[^\x00-\x7f\W\d_]",  # letters that alone may as well be signs
    "[βγδζθκλμπστφχΒΓΔΖΘΚΛΜΠΤΦΧ]",  # few consonants end a Greek word
]
#: More kinds; the first are the second ones of pairs: a capital after a small letter, й after more than a vowel, turns.
MORE_KINDS = ["[A-ZÀ-ÖØ-ÞА-ЯЁΆ-Ϋ]", "(?i)й", CONSONANT, VOWEL, "[€£±]", CONTROL, r"[^\x00-\x7f]"]


def _where(pattern: str) -> np.ndarray:
    """Which code points match; the last stands for all beyond the first 65,536."""
    out = np.zeros(0x10001, bool)
    out[[m.start() for m in re.finditer(pattern, "".join(map(chr, range(0x10000))) + "\U00020000")]] = True
    return out


@cache
def _kinds() -> list[np.ndarray]:
    """Of each code point the bits of its kinds and of more kinds, and the number of its block, 0 for none."""
    bits = [np.packbits([_where(k) for k in kinds], axis=0, bitorder="little")[0] for kinds in (KINDS, MORE_KINDS)]
    return [*bits, np.select([_where(f"[{b}]") for b in BLOCKS], range(1, len(BLOCKS) + 1)).astype(np.uint8)]


def _pairs(kinds: np.ndarray, more: np.ndarray, block: np.ndarray, text: Callable[[], str]) -> float:
    """What pairs of characters count against a text."""
    count = np.count_nonzero
    met = kinds[:-1] & more[1:]
    mixed = count((block[:-1] != block[1:]) & (block[:-1] > 0) & (block[1:] > 0))
    letter = np.zeros(len(kinds) + 2, bool)  # with the ends of the text
    letter[1:-1] = kinds & 16
    before, after = letter[:-2], letter[2:]
    inside, alone, end = count((kinds & 32 > 0) & before & after), count((kinds & 64 > 0) & ~before & ~after), count((kinds & 128 > 0) & ~after)
    numberless = len(NUMBERLESS.findall(text())) if (more & 16).any() else 0
    return 1.5 * (count(met & 1) + mixed) + inside + count(met & 2) + 0.3 * end + 0.85 * (alone + numberless) - 0.3 * count(met & 12)


def _languages(charset_table: dict[str, tuple[str, ...]], falling: float) -> dict[str, list[dict[str, float]]]:
    """Of each charset the weights of its languages' letters, which fall from the first to the last."""
    out: dict[str, list[dict[str, float]]] = {}
    for letters, charsets in charset_table.items():
        weights = {c: 1.0 - falling * i / len(letters) for i, c in enumerate(letters)}
        weights |= {c.upper(): CAPITAL * w for c, w in weights.items() if len(c.upper()) == 1 and c.upper() != c}
        for charset in charsets:
            out.setdefault(charset, []).append(weights)
    return out


SINGLE = _languages(LATIN, 0.0)
for _charset, _weights in _languages(SCRIPTS, 0.8).items():
    SINGLE.setdefault(_charset, []).extend(_weights)
SINGLE["cp1252"].append({c: WESTERN * n for w in SINGLE["cp1252"] for c, n in w.items()})


@cache
def _single() -> tuple[list[str], np.ndarray, np.ndarray, list[list[bytes]], np.ndarray, np.ndarray]:
    """Of charsets of one byte a letter: names, code points of bytes, which bytes stand for none, kinds by byte; weights of languages, and where each charset's begin."""
    chars = [[bytes([b]).decode(charset, "replace") for b in range(256)] for charset in SINGLE]
    codes = np.array([[ord(c) for c in own] for own in chars])
    weights = [[0.0 if c <= "\x7f" else w[c] if c in w else 0.2 if c in QUOTES else -0.5 if c.isalpha() else -1.0 for c in own] for own, languages in zip(chars, SINGLE.values(), strict=True) for w in languages]
    starts = np.cumsum([0, *map(len, SINGLE.values())])[:-1]
    return list(SINGLE), codes, _where(CONTROL)[codes] | (codes == 0xFFFD), [[k[own].tobytes() for k in _kinds()] for own in codes], np.array(weights), starts


@cache
def _wide(charset: str) -> np.ndarray:
    """What the code points count in a charset of several bytes a letter."""
    often, rare = map(_where, WIDE[charset])
    # what only the later extension of a charset has is rare
    usual = np.array([charset != "gb18030" or bool(chr(c).encode("gb2312", "ignore")) for c in range(0x10001)])
    return np.where(_where(r"[\x00-\x7f]"), 0.0, np.where(often, 1.0, np.where(usual & rare, 0.45 if charset in ("gb18030", "big5") else 0.35, np.where(_where(f"[{re.escape(QUOTES)}]"), 0.2, -1.0))))


@cache
def _unmarked() -> np.ndarray:
    """Of each code point its block, or 8 for ideographs, 9 for spaces and signs, 0 for others."""
    block = _kinds()[2]
    return np.where(_where("[一-鿿]"), 8, np.where(block > 0, block, np.where(_where(f"[ \\t\\r\\n!-~{re.escape(QUOTES)}]"), 9, 0))).astype(np.uint8)


def _unmarked_score(codes: np.ndarray) -> float:
    """For UTF-16 and UTF-32 without a mark: letters of one script, with spaces and signs between them."""
    n = np.bincount(_unmarked()[codes], minlength=10).astype(float)
    blocks = n[1:8]
    blocks[5] += 0.6 * n[8]
    return (2 * blocks.max() - blocks.sum() + n[9] - 2 * n[0]) / len(codes)


def _decoded(data: bytes, charset: str) -> str | None:
    try:
        return data.decode(charset)
    except UnicodeDecodeError:
        return None


def ranked(data: bytes) -> list[tuple[str, str, float]]:
    """``text, charset, lag`` of the best candidate and of those that it does not rule out; empty if nothing fits.

    The lag is the evidence for the best one: what its score is ahead, for each of
    the distinct pairs of bytes beyond ASCII.  Repeated words are no more evidence.
    """
    for mark, charset in MARKS:
        if data.startswith(mark):
            text = _decoded(data, charset)
            return [] if text is None else [(text, charset, 0.0)]
    plain = _decoded(data, "utf-8")
    if plain is not None and re.search(CONTROL, plain):
        plain = None
    if plain is not None and (data.isascii() or len(STUCK.findall(plain)) < sum(c > "\x7f" for c in plain)):
        return [(plain, "utf-8", 0.0)]
    # score, letters beyond ASCII, what a pair counts against, charset, kinds of characters, what texts that are equal share
    found: list[tuple[float, int, int, str, Callable[[], list[np.ndarray]], bytes | str]] = []

    def consider(charset: str, score: Callable[[np.ndarray], float]) -> None:
        text = _decoded(data, charset)
        if text:
            codes = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 0x10000)
            more = _kinds()[1][codes]
            if not (more & 32).any():
                beyond = int(np.count_nonzero(more & 64))
                found.append((round(float(score(codes)), 9), beyond, len(text) if charset.startswith("utf") else beyond, charset, lambda: [k[codes] for k in _kinds()], charset))

    for charset in ["utf-16-le", "utf-16-be"] * (len(data) % 2 == 0) + ["utf-32-le", "utf-32-be"] * (len(data) % 4 == 0):
        consider(charset, _unmarked_score)
    own = np.frombuffer(data, np.uint8)
    if b"\x00" not in data:
        n = np.bincount(own, minlength=256)
        beyond, used = int(n[128:].sum()), n > 0
        names, chars, without, kinds, weights, starts = _single()
        scores, same = np.maximum.reduceat(weights @ n, starts) / max(1, beyond), chars[:, used]
        for i in np.flatnonzero(~without[:, used].any(axis=1)):
            found.append((round(float(scores[i]), 9), beyond, beyond, names[i], lambda i=i: [np.frombuffer(data.translate(k), np.uint8) for k in kinds[i]], same[i].tobytes()))
        for charset in WIDE:
            consider(charset, lambda codes, charset=charset: _wide(charset)[codes].sum() / max(1, np.count_nonzero(codes > 127)))
    seen = np.zeros(0x10000, bool)
    seen[own[:-1].astype(np.uint16) << np.uint16(8) | own[1:]] = True
    evidence = int(np.count_nonzero(seen[0x8000:]) + np.count_nonzero(seen[:0x8000].reshape(128, 256)[:, 128:]))
    reach = REACH / max(1, evidence)
    good: list[tuple[float, int, str]] = []
    against: dict[bytes | str, float] = {}
    for score, beyond, size, charset, kinds_of, text in sorted(found, key=lambda f: -f[0]):  # pairs add 0.3 at most
        if good and score + 0.3 < max(good)[0] - reach:
            break
        if text not in against:
            against[text] = float(_pairs(*kinds_of(), lambda charset=charset: data.decode(charset)) / max(1, size))
        good.append((round(score - against[text], 9), beyond, charset))
    good.sort(key=lambda f: -f[0])
    if plain is not None and (not good or good[0][0] < 0.9 or good[0][1] < 8):
        return [(plain, "utf-8", 0.0)]
    if not good or good[0][0] <= 0:
        return []
    return [(data.decode(charset), charset, (good[0][0] - score) * evidence) for score, _, charset in good if score >= good[0][0] - reach]


def detect(data: bytes) -> tuple[str | None, str | None]:
    """The text and the name of its charset; neither if nothing fits."""
    return next((found[:2] for found in ranked(data)), (None, None))


GUESS = StructType().add("text", "string").add("charset", "string").add("fits", ArrayType(StringType())).add("rivals", ArrayType(StringType())).add("lags", ArrayType(DoubleType()))


@F.arrow_udf(GUESS)
def _guessed(content: pa.Array) -> pa.Array:
    kind = pa.struct([("text", pa.string()), ("charset", pa.string()), ("fits", pa.list_(pa.string())), ("rivals", pa.list_(pa.string())), ("lags", pa.list_(pa.float64()))])

    def one(data: bytes | None) -> tuple[str | None, str | None, list[str], list[str], list[float]]:
        found = ranked(data) if data is not None else []
        text, charset = found[0][:2] if found else (None, None)
        rivals = [f for f in found if f[0] != text]
        return text, charset, [c for t, c, _ in found if t == text], [c for _, c, _ in rivals], [lag for _, _, lag in rivals]

    return by_parts(content, lambda part: pa.array([dict(zip(GUESS.names, one(c), strict=True)) for c in part.to_pylist()], kind))


@F.arrow_udf(StringType())
def _read_as(content: pa.Array, charset: pa.Array) -> pa.Array:
    both = pa.StructArray.from_arrays([content, charset], ["content", "charset"])
    return by_parts(both, lambda part: pa.array([x["content"].decode(x["charset"]) for x in part.to_pylist()], pa.string()))


def decoded_with_charset(content: Column) -> Column:
    """``text, charset`` of bytes; nulls where no charset fits.  Plain UTF-8 stays in the JVM."""
    text = content.cast("string")
    stuck = (F.length(text) != F.octet_length(text)) & F.rlike(text, F.lit(STUCK_PAIR))
    plain = F.is_valid_utf8(text) & ~F.contains(text, F.lit("\x00")) & ~stuck
    known = F.struct(F.regexp_replace(text, "^﻿", "").alias("text"), F.lit("utf-8").alias("charset"), *(F.array().cast("array<string>").alias(c) for c in ("fits", "rivals")), F.array().cast("array<double>").alias("lags"))
    return F.when(plain, known).when(content.isNotNull(), _guessed(F.when(~plain, content)))


def _held(rows: DataFrame, name: str) -> DataFrame:
    """A small table, computed once and broadcast; a large one is left to a shuffle."""
    path = work_path(rows.sparkSession, name)
    rows.write.parquet(path)
    rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def decoded_in_folders(files: DataFrame, folder: str) -> DataFrame:
    """``files(folder, content, ...)`` with ``text`` and ``charset``, where a folder tells what bytes alone leave open.

    Files of a folder mostly share a charset.  Of those that a file's bytes do
    not rule out, that one is taken whose number of other files in the folder, as
    a logarithm, is most ahead of its lag.
    """
    path = work_path(files.sparkSession, "guessed")
    guessed = files.select("*", decoded_with_charset(F.col("content")).alias("g")).select("*", "g.*", F.monotonically_increasing_id().alias("row")).drop("g")
    with small_batches(files.sparkSession):
        guessed.write.parquet(path)
    guessed = files.sparkSession.read.schema(guessed.schema).parquet(path)
    # a file that fits its folder's most frequent charset speaks for no other
    sets = guessed.filter(F.size("fits") > 0).groupBy(folder, "fits").agg(F.count(F.lit(1)).alias("n"))
    first = sets.select(folder, "n", F.explode("fits").alias("as")).groupBy(folder, "as").agg(F.sum("n").alias("n")).groupBy(folder).agg(F.max_by("as", F.struct("n", "as")).alias("first"))
    spoken = F.when(F.array_contains("fits", F.col("first")), F.array("first")).otherwise(F.col("fits"))
    votes = sets.join(first, folder).select(folder, "n", F.explode(spoken).alias("as")).groupBy(folder, "as").agg(F.sum("n").alias("n"))
    way = F.arrays_zip(F.concat("fits", "rivals").alias("as"), F.concat(F.transform("fits", lambda _: F.lit(0.0)), "lags").alias("lag"))
    ways = guessed.filter(F.size("rivals") > 0).select("row", folder, "charset", F.size("fits").alias("own"), F.posexplode(way).alias("at", "way")).select("row", folder, "charset", "own", "at", "way.*")
    others = F.greatest(F.coalesce("n", F.lit(0)) - (F.col("at") < F.col("own")).cast("long"), F.lit(0))
    ahead = F.struct(F.log(others + 1.0) - F.col("lag"), -F.col("at"))
    told = ways.join(_held(votes, "votes"), [folder, "as"], "left").groupBy("row", "charset").agg(F.max_by("as", ahead).alias("as"))
    changed = _held(told.filter("as <> charset").select("row", "as"), "told")
    mended = guessed.join(changed, "row").withColumn("text", _read_as(F.col("content"), F.col("as"))).withColumn("charset", F.col("as"))
    kept = [*files.columns, "text", "charset"]
    return guessed.join(changed, "row", "left_anti").select(kept).unionByName(mended.select(kept))
