"""Text that looks the same in one consistent form.

Look-alike characters are mapped one to one and invisible ones removed with built-in expressions; values whose mapped
forms are equal under the accent- and case-sensitive Unicode collation (which knows composed and decomposed accents) form
an equivalence class, grouped in SQL; each class has a deterministic canonical member, which is joined back.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.runtime import materialize, ship, small_side, spread

try:
    import ahocorasick
except ImportError:  # terms are then found by their lengths
    ahocorasick = None

# Letters of other scripts, and below them the Latin letters that they look like.
CYRILLIC = "аеорсухіјѕһԁԛԝӏАВЕКМНОРСТХУІЈЅҮԌԚԜӀ"
CYRILLIC_AS = "aeopcyxijshdqwlABEKMHOPCTXYIJSYGQWI"
GREEK = "οανιρυκχϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ"
GREEK_AS = "oavipukxcjABEZHIKMNOPTYXCJ"
ARMENIAN = "օսոհցզՕՍՏ"
ARMENIAN_AS = "ounhgqOUS"
CHEROKEE = "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ"
CHEROKEE_AS = "ABCDEGHJKLMPRSTVWZ"
LISU = "ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ"
LISU_AS = "ABCDEFGHIJKLMNOPRSTUVWXYZ"
COPTIC = "ⲞⲟⲤⲥⲢⲣⲎⲒⲔⲘⲚⲦⲂ"
COPTIC_AS = "OoCcPpHIKMNTB"
# Latin letters of other forms, and the letters that they look like.
FORMS = "ɑɡᴄᴏᴠᴡᴢꜱ"
FORMS_AS = "agcovwzs"
#: Hyphens that look like the plain one, spaces that look like the plain one.
HYPHENS = "\u2010\u2011\ufe63"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Characters that show nothing, as a character class of regular expressions.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\uffa0"

FOREIGN = CYRILLIC + GREEK + ARMENIAN + CHEROKEE + LISU + COPTIC
FOREIGN_AS = CYRILLIC_AS + GREEK_AS + ARMENIAN_AS + CHEROKEE_AS + LISU_AS + COPTIC_AS
SCRIPTS = r"\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}\p{IsCherokee}\p{IsLisu}\p{IsCoptic}"

#: A word: letters and digits with their marks, whatever punctuation stands around; and what stands between words.
WORD = rf"[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}{INVISIBLE}]*"
GAP = r"[^\p{L}\p{N}]+"

#: Terms in one broadcast automaton, and forms of words in one broadcast table; more are joined by shuffle.
AUTOMATON_TERMS, BROADCAST_FORMS = 50_000, 200_000


@lru_cache(maxsize=1)
def look_alikes() -> dict[str, str]:
    """Character -> the plain character that it looks like.

    By rule from the Unicode data: full-width and half-width forms and the letters and digits of mathematical fonts. Each
    is compared by the plain letter of what it stands for. The rest are the fixed values above.
    """
    table = dict(zip(FOREIGN + FORMS, FOREIGN_AS + FORMS_AS, strict=True)) | dict.fromkeys(HYPHENS, "-") | dict.fromkeys(SPACES, " ")
    for block in (range(0x2100, 0x2150), range(0xFF01, 0xFFEF), range(0x1D400, 0x1D800), range(0x1FBF0, 0x1FBFA)):
        for c in map(chr, block):
            tag, _, points = unicodedata.decomposition(c).partition(" ")
            if tag in ("<font>", "<wide>", "<narrow>") and " " not in points and not unicodedata.category(c).startswith("M"):
                plain = chr(int(points, 16))
                table.setdefault(c, table.get(plain, plain))
    return {k: v for k, v in table.items() if k not in INVISIBLE}


@lru_cache(maxsize=1)
def ligatures() -> dict[str, str]:
    """Latin ligatures of a fixed form -> their letters, from the Unicode data."""
    return {c: unicodedata.normalize("NFKC", c) for c in map(chr, range(0xFB00, 0xFB07))}


def mapped(text: Column) -> Column:
    """The form under which values are compared. Invisible characters inside emoji sequences stay."""
    return _plain(text, look_alikes())


def _plain(text: Column, table: dict[str, str]) -> Column:
    for c, letters in ligatures().items():
        text = F.replace(text, F.lit(c), F.lit(letters))
    # The skin tone is named although \p{Sk} holds it: only with a letter beyond U+FFFF does Java look back by whole letters.
    return F.regexp_replace(F.translate(text, "".join(table), "".join(table.values())), rf"(?<![\p{{So}}\p{{Sk}}️‍🏻])[{INVISIBLE}]+(?!\x{{20e3}})", "")


def _shown(value: Column) -> Column:
    """The form of a value without a twin that is known to be right: plain letters, accents as they are.

    A word all of whose letters are of another script is a word of that script and keeps them, and so does one that is not
    plain after the mapping; joiners stay where a script outside Latin, Cyrillic and Greek needs them.
    """
    own = _plain(value, {k: v for k, v in look_alikes().items() if k not in FOREIGN})
    own = F.when(value.rlike(rf"[\p{{L}}&&[^{SCRIPTS}]]") & value.rlike(r"[\x{200c}\x{200d}]"), value).otherwise(own)
    return F.when(value.rlike(r"\p{IsLatin}") & ~mapped(value).rlike(r"[\p{L}&&[^\p{IsLatin}]]"), mapped(value)).otherwise(own)


def equivalence_classes(values: DataFrame) -> DataFrame:
    """(value, canonical, known) of distinct non-null values: ``values`` has value and preferred (a spelling known to be right).

    The canonical form is that of a preferred member (``known``), else of one without look-alike letters of other scripts,
    else of one wholly in another script, else the mapped form; then one without invisible characters and the first in code
    point order. It may be no member, but is always of the class's look; its accents are those of its member. Several
    preferred members of one class are one spelling for the eye, of which the first in code point order is taken.
    """
    v = F.col("value")
    x = values.where("value is not null").groupBy("value").agg(F.max("preferred").alias("preferred")).withColumn("mapped", mapped(v))
    x = x.withColumn("rank", F.when(F.col("preferred"), 0).when(F.translate(v, FOREIGN, "") == v, 1).when(~v.rlike(r"\p{IsLatin}"), 2).otherwise(3))
    x = x.withColumn("form", F.when(F.col("preferred"), v).otherwise(_shown(v)))
    return x.sparkSession.sql(
        """
        WITH members AS (SELECT value, rank, form, mapped <> value AS odd, mapped COLLATE UNICODE AS look FROM {x}),
             classes AS (SELECT look, min(struct(rank, odd, form)) AS best FROM members GROUP BY look)
        SELECT m.value, c.best.form AS canonical, c.best.rank = 0 AS known FROM members m JOIN classes c ON m.look = c.look
        """,
        x=x,
    )


class _Bases(dict):
    """Code point -> the letters that it is searched by: plain, without marks; nothing for what shows nothing."""

    def __init__(self) -> None:
        self.table = look_alikes() | ligatures()
        self.invisible = frozenset(c for a, _, b in (x.partition("-") for x in _ranges(INVISIBLE)) for c in map(chr, range(ord(a), ord(b or a) + 1)))

    def __missing__(self, point: int) -> str:
        c = chr(point)
        plain = "" if c in self.invisible else unicodedata.normalize("NFD", self.table.get(c, c))
        self[point] = out = "".join(x for x in plain if unicodedata.category(x) not in ("Mn", "Me") and x not in self.invisible)
        return out


def _ranges(kind: str) -> list[str]:
    """The characters and ranges of a character class."""
    out, i = [], 0
    while i < len(kind):
        wide = kind[i + 1 : i + 2] == "-"
        out.append(kind[i : i + 3] if wide else kind[i])
        i += 3 if wide else 1
    return out


_BASES = _Bases()


def skeleton(text: str) -> str:
    """What a text is searched by: values of one look have one skeleton. Equality is decided by the classes."""
    return text if text.isascii() else text.translate(_BASES)


def _places(text: str) -> list[int]:
    """Where each character of the skeleton stands in the text, and the text's end."""
    out = [i for i, c in enumerate(text) for _ in _BASES[ord(c)]]
    out.append(len(text))
    return out


class Hits:
    """Finds all terms in a text, also nested and overlapping ones. It is sent to workers and builds its automaton there."""

    def __init__(self, terms: list[str]) -> None:
        self.terms, self._automaton = terms, None

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "_automaton": None}

    def __call__(self, plain: str):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for t in self.terms:
                self._automaton.add_word(t, len(t))
            if self.terms:
                self._automaton.make_automaton()
        if self.terms:
            for last, size in self._automaton.iter(plain):
                yield last + 1 - size, last + 1


class Lengths:
    """All stretches of a text between borders that are as long as a term may be: for terms that are joined."""

    def __init__(self, lengths: list[int]) -> None:
        self.lengths = lengths

    def __call__(self, plain: str):
        for i in range(len(plain)):
            if not (i and plain[i - 1].isalnum()):
                for n in self.lengths:
                    if i + n <= len(plain):
                        yield i, i + n


def spellings(text: str, hits) -> set[tuple[str, str]]:
    """(value, skeleton) of the stretches of a text that ``hits`` finds and that no letter or digit continues."""
    plain, out, places = skeleton(text), set(), None
    for i, k in hits(plain):
        if i and plain[i - 1].isalnum() or k < len(plain) and plain[k].isalnum():
            continue
        if text is plain:
            value = plain[i:k]
        else:
            places = places or _places(text)
            if i and places[i] == places[i - 1] or k < len(plain) and places[k] == places[k - 1]:
                continue  # a ligature's part
            value = text[places[i] : places[k]].rstrip("".join(_BASES.invisible))
        out.add((value, plain[i:k]))
    return out


def find_terms(texts: DataFrame, terms: DataFrame, key: str, text: str, whole: bool = False) -> DataFrame:
    """(key, term_id, value, canonical): values of the text that look like a term, and whether spelled otherwise.

    ``terms`` has term_id and term. With ``whole`` the text must be the term and nothing else. Terms inside and across
    others are found as well; each value stands once for each row. Null and empty texts and terms have no value; a term
    that stands under several ids gives a row for each; repeated rows of the text give their values again. Another case, a
    missing accent or another letter is another look. More than AUTOMATON_TERMS terms are joined by their skeletons.
    """
    ship(texts.sparkSession)
    known = terms.select("term_id", "term").where("term is not null and term <> ''")
    plain = known.select("term").distinct().select(F.pandas_udf(lambda s: s.map(skeleton), "string")("term").alias("skeleton")).where("skeleton <> ''").distinct()
    rows = plain.limit(AUTOMATON_TERMS + 1).collect()
    joined = len(rows) > AUTOMATON_TERMS or ahocorasick is None
    if joined:
        hits = Lengths(sorted(r.n for r in plain.select(F.length("skeleton").alias("n")).distinct().collect()))  # as many as there are lengths of terms
    else:
        hits = Hits(sorted(r.skeleton for r in rows))
    shared = texts.sparkSession.sparkContext.broadcast(hits)
    x = spread(texts.select(texts[key].alias("k"), texts[text].alias("t")).where("t is not null and t <> ''"))

    def search(batches):
        find = shared.value
        for p in batches:
            at, values = [], []
            for i, t in enumerate(p["t"]):
                if whole:
                    s = skeleton(t)
                    got = [(t, s)] if any(i == 0 and k == len(s) for i, k in find(s)) else []
                else:
                    got = sorted(spellings(t, find))
                at += [i] * len(got)
                values += got
            out = pd.DataFrame(values, columns=["value", "skeleton"])
            out.insert(0, "k", p["k"].to_numpy()[at])
            yield out

    found = x.mapInPandas(search, f"k {x.schema['k'].dataType.simpleString()}, value string, skeleton string")
    if joined:
        found = found.join(plain, "skeleton", "left_semi")
    found = materialize(found.select("k", "value"))  # few spellings, read several times below; the texts are searched once
    classes = equivalence_classes(found.select("value", F.lit(False).alias("preferred")).unionByName(known.select(F.col("term").alias("value"), F.lit(True).alias("preferred"))))
    # Classes of the found spellings that hold a term; terms are few, so are the spellings of each.
    ids = classes.join(classes.select(F.col("value").alias("term"), F.col("canonical").alias("c")).join(known, "term"), F.col("canonical") == F.col("c")).select("value", "canonical", "term_id", "term")
    return found.join(ids, "value").select(F.col("k").alias(key), "term_id", "term", "value", "canonical")


def composed(values: Column) -> Column:
    """Letters and accents in one character where there is one; there is no built-in expression for it."""
    return F.pandas_udf(lambda s: s.str.normalize("NFC"), "string")(values)


def _reworded(parts: DataFrame, forms: dict[str, str]) -> DataFrame:
    """``parts`` (k, ps array<string>) with each piece replaced by its form."""
    shared = parts.sparkSession.sparkContext.broadcast(forms)

    def put(batches):
        of = shared.value
        for batch in batches:
            lists = batch.column("ps")
            words = lists.flatten().dictionary_encode()
            new = pa.array([of.get(w, w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
            offsets = pa.array(lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.ListArray.from_arrays(offsets, new)], ["k", "ps"])

    return parts.mapInArrow(put, parts.schema)


def canonical_texts(df: DataFrame, key: str, text: str, terms: DataFrame | None = None) -> DataFrame:
    """(key, text) with each word replaced by its class's canonical form and look-alike punctuation and spaces by plain ones.

    A word is a run of letters and digits. Words of plain characters stay as they are, so only others are grouped, with the
    plain words that they may stand for and the words of ``terms`` (with a column term), whose spelling is the right one;
    other forms have composed accents. Null texts stay null, empty ones empty; repeated rows stay repeated.
    """
    ship(df.sparkSession)
    x = spread(df.select(df[key].alias("k"), df[text].alias("t")))
    other = r"[^\x00-\x7f]"
    some = x.where(F.col("t").rlike(other))
    odd = some.select(F.explode(F.array_distinct(F.filter(F.regexp_extract_all("t", F.lit(WORD), 0), lambda w: w.rlike(other)))).alias("word"))
    distinct_odd = materialize(odd.distinct())  # as many as there are such words; the texts are read once for them
    # Of the plain words of all texts only those that an odd one may stand for are kept, before anything is shuffled.
    wanted = small_side(distinct_odd.select(mapped(F.col("word")).alias("value")).where(~F.col("value").rlike(other)).distinct(), BROADCAST_FORMS)
    plain = x.where("t is not null").select(F.explode(F.regexp_extract_all("t", F.lit(WORD), 0)).alias("value")).join(wanted, "value", "left_semi").distinct()
    values = distinct_odd.select(F.col("word").alias("value"), F.lit(False).alias("preferred")).unionByName(plain.select("value", F.lit(False).alias("preferred")))
    if terms is not None:
        values = values.unionByName(terms.where("term is not null").select(F.explode(F.regexp_extract_all("term", F.lit(WORD), 0)).alias("value"), F.lit(True).alias("preferred")))
    classes = equivalence_classes(values)
    forms = classes.select(F.col("value").alias("word"), F.when(F.col("known"), F.col("canonical")).otherwise(composed(F.col("canonical"))).alias("canonical")).where("canonical <> word and canonical is not null")
    forms = materialize(forms)
    parts = some.select("k", "t", F.regexp_extract_all("t", F.lit(f"{WORD}|{GAP}"), 0).alias("ps"))
    rows = forms.limit(BROADCAST_FORMS + 1).collect()
    if len(rows) <= BROADCAST_FORMS:
        again = _reworded(parts.select("k", "ps"), {r.word: r.canonical for r in rows})
    else:
        # Texts are named by two hashes of their content, so the names are the same whenever a text is read.
        parts = parts.withColumns({"h1": F.xxhash64("t"), "h2": F.xxhash64(F.lit(1), "t")})
        changed = parts.select("h1", "h2", F.explode(F.array_distinct("ps")).alias("word")).where(F.col("word").rlike(other)).distinct().join(forms, "word")
        changed = changed.groupBy("h1", "h2").agg(F.map_from_entries(F.collect_list(F.struct("word", "canonical"))).alias("forms"))
        again = parts.join(changed, ["h1", "h2"], "left").select("k", F.transform("ps", lambda w: F.coalesce(F.try_element_at("forms", w), w)).alias("ps"))
    # A gap's class is its mapped form; a word's is what its class says.
    shown = lambda w: F.when(w.rlike(other) & w.rlike(f"^{GAP}$"), mapped(w)).otherwise(w)
    again = again.select("k", F.array_join(F.transform("ps", shown), "").alias("t"))
    return again.unionByName(x.where(~F.coalesce(F.col("t").rlike(other), F.lit(False))).select("k", "t")).toDF(key, text)
