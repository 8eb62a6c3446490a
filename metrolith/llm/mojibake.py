"""Text decoded with the wrong character encoding: found, and restored where it can be.

Two kinds of evidence are used.

* Multi-byte encodings read a byte at a time leave sequences that no text holds otherwise. The
  sequences of all characters of the supported scripts under all pairs of encodings are
  computed once a process and matched with an automaton; runs of them are replaced, nothing else.
* Single-byte encodings read as one another turn letters into other letters, or into signs where no text has them: those are
  generated from the tables of all pairs. Words are counted
  over the distinct texts of the corpus; a word is garbled when one pair of encodings turns it into a word that
  is many times as frequent, or into a word known outside the source that has it most whose pairs of letters
  are many times as common there. This is a join of distinct words, so it needs no word list.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrolith.session import Workspace

#: Encodings that UTF-8 is taken for, the likelier first.
WRONG_FOR_UTF8 = ("cp1252", "latin-1", "mac-roman", "cp1251", "cp437", "cp850", "cp1250")
#: Japanese encodings, and what they are taken for.
WRONG_FOR_JAPANESE = (("shift_jis", "cp1252"), ("shift_jis", "latin-1"), ("euc_jp", "latin-1"), ("euc_jp", "cp1252"))
#: (true, wrong) pairs of single-byte encodings.
SINGLE_BYTE = tuple(
    (t, w)
    for t, ws in (
        ("cp1250", ("cp1252", "latin-1", "cp1251")), ("iso8859-2", ("cp1252", "latin-1", "cp1250")), ("cp852", ("cp1252", "cp437", "cp850")), ("mac-latin2", ("cp1252", "cp1250")),
        ("cp1251", ("cp1252", "latin-1", "koi8-r", "cp866", "cp1250", "mac-cyrillic")), ("koi8-r", ("cp1252", "latin-1", "cp1251", "cp866", "cp1250")), ("cp866", ("cp1252", "cp1251", "koi8-r", "cp437", "cp850", "cp1250")), ("iso8859-5", ("cp1252", "cp1251")), ("mac-cyrillic", ("cp1252", "cp1251")),
        ("cp1253", ("cp1252", "latin-1", "cp1250", "cp1251")), ("iso8859-7", ("cp1252", "cp1250")), ("cp737", ("cp1252", "cp437", "cp850")),
        ("cp1254", ("cp1252", "latin-1", "cp1250")), ("cp857", ("cp1252", "cp850")),
        ("cp437", ("cp1252", "latin-1", "cp1250")), ("cp850", ("cp1252", "latin-1", "cp1250")), ("mac-roman", ("cp1252", "latin-1")), ("cp1252", ("mac-roman", "cp437", "cp850", "cp1250", "cp1251", "koi8-r", "cp866")),
    )
    for w in ws
)
#: A word is garbled when its restored form is at least so many times as frequent (or its letters are), and occurs in so many texts.
RATIO, LEAST = 5, 3

_C1 = re.compile("[\x80-\x84\x86-\x9f]")
_JAPANESE = re.compile("[぀-ヿ㐀-鿿]")
#: From one byte of a kana's first half on, whatever may follow in a garbled Japanese stretch.
_STRETCH = re.compile("[\x81-\xfc‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œžŸŽ€][!-\xff‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œžŸŽ€]{5,}")
#: A kana of a Japanese encoding, read a byte at a time.
_KANA = re.compile("[\x82‚][\x9f-\xf1Ÿ]|[\x83ƒ][@-\x96€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–]|[¤¥][¡-ö]")
#: Marks that stand between words in any language.
_BETWEEN = "‐-‖‘-‚“-„…«»‹›"
#: A word: letters and whatever else beyond ASCII hangs on to them.
_WORD = re.compile(r"[^\s\x00-\x40\x5b-\x60\x7b-\x7f]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: Signs that stand between lower-case letters in clean text, besides dashes, quotes, blanks, numerals and signs of mathematics.
_AMID = "…•·©®™°§¶˜´`^¨¯¸"
#: í in UTF-8 is Ã and a soft hyphen, which is easily lost.
_LONE = re.compile("(?<=[a-z])Ã(?=[a-z])")
#: Length of a text is no limit to a quotation, but a line is.
_QUOTED = "[^\n{0}]*"


def _bytes_of(ch: str, enc: str) -> bytes | None:
    try:
        return ch.encode(enc)
    except UnicodeEncodeError:
        return None


def _read(raw: bytes, enc: str) -> str | None:
    """Bytes read one by one; where a code page leaves one undefined, the control character of its number."""
    out = []
    for x in raw:
        try:
            out.append(bytes([x]).decode(enc))
        except UnicodeDecodeError:
            if not enc.startswith("cp125"):
                return None
            out.append(chr(x))
    return "".join(out)


def _alphabet() -> list[str]:
    """Characters whose garbled forms are searched for: letters and marks of European scripts, punctuation, signs, Japanese, emoji."""
    spans = [(0x80, 0x180), (0x192, 0x193), (0x218, 0x21C), (0x2C6, 0x2C8), (0x2DA, 0x2DD), (0x300, 0x30D), (0x323, 0x324), (0x326, 0x329), (0x386, 0x3CF), (0x401, 0x460), (0x490, 0x492),
             (0x2010, 0x2028), (0x202F, 0x2040), (0x2070, 0x2090), (0x20A0, 0x20C0), (0x2100, 0x2150), (0x2153, 0x215F), (0x2190, 0x2200), (0x2200, 0x2270), (0x25A0, 0x2670), (0x2700, 0x27C0), (0x3000, 0x3100), (0xFE0F, 0xFE10), (0xFF01, 0xFFA0), (0xFFFD, 0xFFFE), (0x1F1E6, 0x1F200), (0x1F300, 0x1F700), (0x1F900, 0x1FA00)]
    chars = [chr(c) for a, b in spans for c in range(a, b)]
    return chars + [c for c in map(chr, range(0x4E00, 0xA000)) if _bytes_of(c, "shift_jis")]


#: Kinds of evidence in a match: sure; sure inside a word only; only in a run of its like; sure after a small letter; sure inside a word or after a figure.
SURE, INSIDE, RUN, MARK, FIGURE = 0, 1, 2, 3, 4


def _kind(seq: str, enc: str, original: str) -> int:
    if any("\x80" <= c <= "\x9f" for c in seq):
        return SURE
    if all("─" <= c <= "▟" for c in seq):
        return RUN if seq[0] in "╨╤" else FIGURE if original in "°ºª²³½¼¾" else INSIDE
    if unicodedata.combining(original) and all(unicodedata.category(c)[0] == "L" for c in seq) and unicodedata.category(seq[0]) == "Lu":
        return MARK
    if all(unicodedata.category(c)[0] == "L" for c in seq):
        if len(seq) == 2 and seq[0] in "ÂÃÄÅ" and enc in ("cp1252", "latin-1"):
            return SURE
        return SURE if len(seq) > 2 and not original.isalpha() else RUN
    if len(seq) == 2 and re.match(f"[{_BETWEEN}€• °]", seq[1]):
        return INSIDE
    return SURE


class _Automaton:
    def __init__(self):
        found: dict[str, tuple[str, int, str]] = {}
        chars = _alphabet()
        for wrong in WRONG_FOR_UTF8:
            for ch in chars:
                seq = _read(ch.encode("utf-8"), wrong)
                if seq and seq not in found:
                    found[seq] = (ch, _kind(seq, wrong, ch), wrong)
        for true, wrong in WRONG_FOR_JAPANESE:
            for ch in chars:
                raw = _bytes_of(ch, true) if ch >= "　" else None
                seq = _read(raw, wrong) if raw and len(raw) == 2 else None
                if seq and seq not in found:
                    found[seq] = (ch, RUN, f"{true}/{wrong}")
        self.auto = ahocorasick.Automaton()
        for seq, x in found.items():
            self.auto.add_word(seq, (len(seq), seq, *x))
        self.auto.make_automaton()
        # Any evidence holds one of these pairs, so most texts need no search: the first two characters of a sequence of
        # its encoding, or a garbled kana.
        pairs = []
        for wrong in WRONG_FOR_UTF8:
            own = [s for s, x in found.items() if x[2] == wrong]
            pairs.append("".join("[" + "".join(map(re.escape, sorted({s[k] for s in own}))) + "]" for k in (0, 1)))
        self.may = re.compile("|".join([*pairs, _KANA.pattern]))

    def matches(self, text: str) -> list[tuple[int, int, str, int, str]]:
        """(start, end, original, kind, encodings) of the leftmost longest matches, only those that are evidence."""
        best: dict[int, tuple[int, str, int, str]] = {}
        for end, (n, _, ch, kind, enc) in self.auto.iter(text):
            start = end - n + 1
            if start not in best or best[start][0] < end + 1:
                best[start] = (end + 1, ch, kind, enc)
        out, at = [], 0
        for start in sorted(best):
            if start >= at:
                out.append((start, *best[start]))
                at = best[start][0]
        return self._evident(text, out)

    @staticmethod
    def _evident(text: str, hits: list) -> list:
        keep, i = [], 0
        while i < len(hits):
            j = i + 1
            while j < len(hits) and hits[j][0] == hits[j - 1][1] and (hits[j][3] != RUN or hits[i][3] != RUN or hits[j][4] == hits[i][4]):
                j += 1
            run = hits[i:j]
            enough = 3 if "/" in run[0][4] else 2
            sure = any(h[3] == SURE for h in run)
            japanese = any("/" in h[4] for h in run)
            for h in run:
                s, e, _, kind, _ = h
                before, after = text[s - 1 : s], text[e : e + 1]
                if kind == SURE:
                    keep.append(h)
                elif kind == MARK and (sure or "a" <= before <= "z"):
                    keep.append(h)
                elif kind == FIGURE and before.isdigit():
                    keep.append(h)
                elif kind in (INSIDE, FIGURE) and (sure or (before.isalpha() and (before.islower() or not before.isascii())) or after.isalpha()):
                    keep.append(h)
                elif kind == RUN and not japanese and text[s] >= "Ͱ" and ((before.isascii() and before.isalpha()) or (after.isascii() and after.isalpha())):
                    keep.append(h)  # letters of two scripts in one word
                elif kind == RUN and (sure or len(run) >= enough) and (not japanese or any("぀" <= x[2] <= "ヿ" for x in run)):
                    keep.append(h)
            i = j
        return keep


_automaton: _Automaton | None = None


def automaton() -> _Automaton:
    global _automaton
    if _automaton is None:
        _automaton = _Automaton()
    return _automaton


def repair_sequences(text: str) -> tuple[str, bool]:
    """The text with garbled sequences replaced, again while some are left (text may be garbled several times), and whether there was evidence at all."""
    evident = "�" in text or bool(_C1.search(text))
    if text.isascii():
        return text, False
    auto = automaton()
    whole = _japanese_stretches(text)
    evident, text = evident or whole != text, whole
    while auto.may.search(text):  # every replacement shortens the text
        hits = auto.matches(text)
        if not hits:
            break
        evident = True
        parts, at = [], 0
        for s, e, ch, _, _ in hits:
            parts += [text[at:s], ch]
            at = e
        text = "".join(parts) + text[at:]
    return text, evident


def _japanese_stretches(text: str) -> str:
    """Stretches that a Japanese encoding explains as a whole (single characters would not tell where one begins)."""
    if len(_KANA.findall(text)) < 3:
        return text

    def fix(m: re.Match) -> str:
        raw = m[0]
        for true, wrong in WRONG_FOR_JAPANESE:
            try:
                new = b"".join(_byte(c, wrong) for c in raw).decode(true)
            except (UnicodeDecodeError, KeyError):
                continue
            if 3 * len(_JAPANESE.findall(new)) >= len(new) and re.search("[぀-ヿ]", new) and len(_JAPANESE.findall(new)) >= 3:
                return new
        return raw

    return _STRETCH.sub(fix, text)


def _byte(ch: str, enc: str) -> bytes:
    """The byte that reads as a character; KeyError for none."""
    if enc not in _byte_tables:
        _byte_tables[enc] = {_read(bytes([x]), enc): bytes([x]) for x in range(256)}
    return _byte_tables[enc][ch]


_byte_tables: dict[str, dict[str | None, bytes]] = {}


class _Inside:
    """Signs that single-byte encodings make of letters, degree signs and quotation marks, and where they show.

    ``letters``: readings of lower-case letters that are no letters, or are capitals, and do not stand between letters otherwise;
    ``closing``: those that are closing quotes; ``degree``: letters that a degree sign is read as; ``quotes``: pairs of signs that
    angle quotes are read as.
    """

    def __init__(self):
        letters, closing, degree, quotes = set(), set(), set(), set()
        for m, _ in _tables():
            back = {v: chr(k) for k, v in m.items()}
            for k, v in m.items():
                x = chr(k)
                kind = unicodedata.category(x)
                if unicodedata.category(v) == "Ll" and x > "\x9f":
                    if kind == "Lu" and x < "\u0250" and x not in "ÀÁÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝÄÅÆÇÐÑØÞŸ" or kind in ("Sc", "Po", "Ps", "Lm", "Sk", "So") and x not in _AMID + "„€" or x == "ƒ":
                        letters.add(x)
                    elif x in "”":
                        closing.add(x)
                elif v == "°" and kind[0] == "L":
                    degree.add(x)
            pair = back.get("«"), back.get("»")
            if all(pair) and all(unicodedata.category(x)[0] == "S" for x in pair):
                quotes.add(pair)
        group = lambda xs: "[" + "".join(map(re.escape, sorted(xs))) + "]"
        self.letter = re.compile(f"(?<=[A-Za-z]){group(letters)}(?=[a-z])")
        # These are the first halves of UTF-8 letters; a lone one is what a soft hyphen that got lost has left.
        self.own = re.compile(f"(?<=[A-Za-z]){group(letters - set('ÂÃ'))}(?=[a-z])")
        self.closing = re.compile(f"(?<=[A-Za-z]){group(closing)}(?=[a-z])")
        self.degree = re.compile(f"(?<=[0-9]){group(degree)}(?!\\w)")
        self.quotes = [re.compile(f"{re.escape(o)}(?=\\w)({_QUOTED.format(re.escape(o + c))}[\\w.!?…’]){re.escape(c)}(?![\\w\\\\])") for o, c in sorted(quotes)]

    def found(self, text: str) -> bool:
        if self.letter.search(text) or self.degree.search(text) or any(q.search(text) for q in self.quotes):
            return True
        # A closing quote counts where nothing has been opened.
        return bool(self.closing.search(text)) and text.count("”") > text.count("“") + text.count("„")

    def in_word(self, word: str) -> bool:
        return bool(self.own.search(word) or self.closing.search(word))

    def restored(self, text: str) -> str:
        text = _LONE.sub("í", self.degree.sub("°", text))
        for q in self.quotes:
            text = q.sub(r"«\1»", text)
        return text


_inside: _Inside | None = None


def inside() -> _Inside:
    global _inside
    if _inside is None:
        _inside = _Inside()
    return _inside


def inside_evidence(text: str) -> bool:
    """Whether single characters stand where no text has them, so that their encoding must be wrong."""
    return inside().found(text)


def words_of(text: str) -> list[str]:
    """Distinct words with a character beyond ASCII, none of Japanese."""
    return sorted({w for w in _WORD.findall(text) if not w.isascii() and not _JAPANESE.search(w)})


def bare(word: str) -> str:
    return _EDGE.sub("", unicodedata.normalize("NFC", word))


def _tables() -> list[tuple[dict[int, str], frozenset[str]]]:
    out = []
    for true, wrong in SINGLE_BYTE:
        m, known = {}, set()
        for x in range(128, 256):
            a, b = _read(bytes([x]), wrong), _read(bytes([x]), true)
            if a:
                known.add(a)
                if b and a != b:
                    m[ord(a)] = b
        out.append((m, frozenset(known)))
    return out


_single: list | None = None


def restored_forms(word: str) -> dict[str, int]:
    """What the word may have been, and under how many pairs of single-byte encodings; nothing that is no word, or too short to tell."""
    global _single
    if _single is None:
        _single = _tables()
    odd = {c for c in word if c > "\x7f"}
    own = bare(word)
    out: dict[str, int] = {}
    for m, known in _single:
        if odd <= known:
            w = bare(word.translate(m))
            if w != own and (len(w) >= 3 or len(w) == 2 and len(odd) == 2 and not any(c.isascii() for c in w)) and all(c.isalpha() or c in "'’" for c in w):
                out[w] = out.get(w, 0) + 1
    return dict(sorted(out.items()))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hit, words = [], []
        for t in b.column("text").to_pylist():
            if t is None or t.isascii():
                hit.append(False)
                words.append([])
                continue
            fixed, evident = repair_sequences(t)
            hit.append(evident or inside_evidence(t))
            words.append(words_of(inside().restored(fixed)))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "text_key", "source")), pa.array(hit, pa.bool_()), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "text_key", "source", "hit", "words"])


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, own, f, votes, sure = [], [], [], [], []
        for i, word in enumerate(b.column("word").to_pylist()):
            forms, inner = restored_forms(word), inside().in_word(word)
            for x, v in forms.items():
                at.append(i)
                own.append(bare(word))
                f.append(x)
                votes.append(v)
                sure.append(inner)
        rows = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in ("word", "n", "docs", "top")), pa.array(own, pa.string()), pa.array(f, pa.string()), pa.array(votes, pa.int32()), pa.array(sure, pa.bool_())], names=["word", "n", "docs", "top", "own", "fixed", "votes", "sure"])


def _bare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([bare(w) for w in b.column("word").to_pylist()], pa.string()), *(b.column(c) for c in ("source", "n", "docs"))], names=["fixed", "source", "n", "docs"])


def _letter_pairs(word: str):
    """Pairs of neighbouring letters of a column of words, both ends marked; case does not count."""
    w = F.concat(F.lit("^"), F.lower(word), F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substr(w, i, F.lit(2)))


def garbled_words(scanned: DataFrame, ws: Workspace) -> DataFrame:
    """word, fixed of the distinct words that one pair of encodings turns into a far more frequent one, or a far likelier one.

    Copies of a text count once. Where the garbled form is not rare, because a whole source or many texts have it,
    the restored form must occur in ``LEAST`` texts outside the source that has the garbled one most, and the pairs of
    letters in which the two differ must, in geometric mean, be in ``RATIO`` times as many distinct words found outside that source.
    """
    once = scanned.where(F.size("words") > 0).groupBy("text_key").agg(F.min("source").alias("source"), F.first("words").alias("words"), F.count("*").alias("copies"))
    by_source = once.select("source", "copies", F.explode("words").alias("word")).groupBy("word", "source").agg(F.count("*").alias("n"), F.sum("copies").alias("docs"))
    # Distinct words are few bytes and much work, so they are spread over all cores, whatever their size.
    parts = 2 * scanned.sparkSession.sparkContext.defaultParallelism
    # A text without a source belongs to none that could be left out.
    counts = by_source.repartition(parts, "word").groupBy("word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.max_by("source", F.struct("n", "source")).alias("top"))
    known = by_source.mapInArrow(_bare_words, "fixed string, source string, n long, docs long").groupBy("fixed", "source").agg(F.sum("n").alias("m"), F.sum("docs").alias("m_docs"))
    common = known.groupBy("fixed").agg(F.sum("m").alias("m"), F.sum("m_docs").alias("m_docs")).where(F.col("m_docs") >= LEAST)
    made = counts.mapInArrow(_forms, "word string, n long, docs long, top string, own string, fixed string, votes int, sure boolean").join(common, "fixed", "left")
    every = ws.keep(made.where("m is not null or sure"))  # the forms are much work, and read four times
    # A word with a sign in its middle is garbled in any case: of its forms the most frequent counts, and of unknown ones that of most pairs.
    sure = every.where("sure").groupBy("word").agg(F.max(F.struct(F.coalesce("m", F.lit(0)).alias("m"), "votes", "fixed")).alias("b")).select("word", "b.fixed", "b.m")
    forms = every.where("m is not null and not sure")
    # Documents tell where texts are too few to, but copies of the restored form must not outweigh more texts with the other.
    rare = ((F.col("m") >= LEAST) & (F.col("m") >= RATIO * F.col("n"))) | ((F.col("m_docs") >= RATIO * F.col("docs")) & (F.col("m") >= F.col("n")))
    frequent = forms.where(rare).select("word", "fixed", "m")
    left_out = known.select("fixed", F.col("source").alias("top"), F.col("m").alias("inside"))
    rest = forms.where(~rare & (F.length("fixed") >= 3) & (F.length("fixed") == F.length("own"))).join(left_out, ["fixed", "top"], "left").where(F.col("m") - F.coalesce("inside", F.lit(0)) >= LEAST)
    # Distinct words with a pair of letters, and those of them that only one source has.
    words = known.groupBy("fixed").agg(F.when(F.count("*") == 1, F.first("source")).alias("only"))
    pairs = words.select(F.explode(F.array_distinct(_letter_pairs("fixed"))).alias("pair"), "only").groupBy("pair", "only").agg(F.count("*").alias("k"))
    total = pairs.groupBy("pair").agg(F.sum("k").alias("k"))
    alone = pairs.where("only is not null").select("pair", F.col("only").alias("top"), F.col("k").alias("inside"))
    new, old = _letter_pairs("fixed"), _letter_pairs("own")
    sides = F.flatten(F.array(F.transform(F.array_except(new, old), lambda x: F.struct(x.alias("pair"), F.lit(1).alias("side"))), F.transform(F.array_except(old, new), lambda x: F.struct(x.alias("pair"), F.lit(-1).alias("side")))))
    told = rest.select("word", "fixed", "m", "top", F.explode(sides).alias("x")).select("word", "fixed", "m", "top", "x.*").join(total, "pair", "left").join(alone, ["pair", "top"], "left")
    weight = F.log(F.coalesce("k", F.lit(0)) - F.coalesce("inside", F.lit(0)) + 0.5)
    mean = lambda side: F.avg(F.when(F.col("side") == side, weight))
    likelier = told.groupBy("word", "fixed", "m").agg((mean(1) - mean(-1)).alias("gain")).where(F.col("gain") >= float(math.log(RATIO))).select("word", "fixed", "m")
    return frequent.unionByName(likelier).unionByName(sure).groupBy("word").agg(F.max_by("fixed", F.struct("m", "fixed")).alias("fixed"))


def _scanned(docs: DataFrame, ws: Workspace) -> DataFrame:
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), source.alias("source"))
    return ws.keep(read.withColumn("text_key", F.xxhash64("text")).mapInArrow(_scan, "doc_id long, text_key long, source string, hit boolean, words array<string>"))


def garbled_documents(docs: DataFrame, ws: Workspace) -> DataFrame:
    """doc_id of each document with a garbled stretch, once.

    Null, empty and ASCII texts are none; a text with a replacement character or a C1 control
    (other than NEL) is one even where nothing can be restored. Texts are searched whole.
    """
    scanned = _scanned(docs, ws)
    bad = ws.keep(garbled_words(scanned, ws))
    by_word = scanned.where("not hit").select("doc_id", F.explode("words").alias("word")).join(bad, "word", "left_semi").select("doc_id")
    return ws.finish(scanned.where("hit").select("doc_id").unionByName(by_word).where("doc_id is not null").distinct())


def restored_documents(docs: DataFrame, ws: Workspace) -> DataFrame:
    """doc_id, restored of every document whose text changes: sequences replaced, then garbled words; all other text as it was."""
    scanned = _scanned(docs, ws)
    bad = ws.keep(garbled_words(scanned, ws))
    swaps = scanned.select("doc_id", F.explode("words").alias("word")).join(bad, "word").distinct().groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "fixed"))).alias("swaps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = [], []
            for d, t, s in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("swaps").to_pylist()):
                new = inside().restored(repair_sequences(t)[0])
                if s:
                    pairs = dict(s)
                    new = _WORD.sub(lambda m: _keep_edges(m[0], pairs[m[0]]) if m[0] in pairs else m[0], new)
                if new != t:
                    ids.append(d)
                    texts.append(new)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "restored"])

    touched = ws.keep(scanned.where("hit").select("doc_id").distinct().join(swaps, "doc_id", "full"))
    ws.drop(*(t for t in ws.kept if t is not touched))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(touched, "doc_id").mapInArrow(run, "doc_id long, restored string")


def _keep_edges(word: str, fixed: str) -> str:
    """The restored word within the punctuation around the garbled one that all encodings share."""
    lead = re.match(f"[{_BETWEEN}]*", word)[0]
    tail = re.search(f"[{_BETWEEN}]*$", word[len(lead) :])[0]
    return lead + fixed + tail
