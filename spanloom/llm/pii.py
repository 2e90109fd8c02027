"""Personal information in free text: candidates from high-recall generators, chosen by boosted trees.

Generators propose overlapping spans of five types. Trees fitted on a bounded sample of requests, labelled by what an
earlier scanner reported, score each span by its format and its surroundings. The reports are incomplete, so a calibrated
score is the share of reported cases; a span is taken from half of what true spans reach (positive and unlabelled
learning), and of overlapping spans the best stay.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import boosting
from spanloom.llm.credentials import Clean
from spanloom.llm.vocabulary import with_vocabulary
from spanloom.runtime import ship, spread

#: Requests whose candidates the trees are fitted on, chosen by a hash of their id.
TRAINING_REQUESTS = 6_000
#: Given names that are broadcast; of more, each text gets its own by a join.
MAX_NAMES = 200_000
TYPES = ("EMAIL_ADDRESS", "PHONE_NUMBER", "ID_NUMBER", "STREET_ADDRESS", "PERSON")
#: Types of the reports that are of one type here.
REPORTED = {t: t for t in TYPES} | dict.fromkeys("US_SSN US_ITIN US_PASSPORT UK_NINO UK_NHS UK_PASSPORT DE_TAX_ID DE_PASSPORT ES_NIF ES_NIE FR_NIR IT_FISCAL_CODE PL_PESEL FI_PERSONAL_IDENTITY_CODE SE_PERSONNUMMER NATIONAL_ID".split(), "ID_NUMBER")

_UP, _LOW = "A-ZÀ-ÖØ-ÞŁŚŽŠŐŰĆČĐŘŇŤ", "a-zß-öø-ÿłśžšőűćčđřňťąęěůž"
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Dra|Prof|Sr|Sra|Srta|Herrn?|Frau|Mme|Mlle|Monsieur|Madame|Señor|Señora|Don|Doña|M)\.?"
_PARTICLE = r"(?:van der|van den|van de|von der|vom|van|von|zu|de la|de los|de las|del|de|du|da|dos|di|della|le|la|ter|ten|al|bin|Mc|Mac|Saint|St\.)"
_WORD = rf"(?:[DdLO]['’])?[{_UP}](?:[{_UP}{_LOW}]|['’](?=[{_UP}{_LOW}]))+(?:-[{_UP}][{_UP}{_LOW}]+)*"
_RUN = re.compile(rf"(?<![\w@/.'’-])(?:{_TITLE} )?(?:{_WORD}|[{_UP}]\.)(?: (?:[{_UP}]\.|{_PARTICLE}(?= [{_UP}])|{_WORD})){{0,5}}")
_COMMA = re.compile(rf"(?<![\w@/.'’-])(?=((?:(?:{_PARTICLE}) )?{_WORD}(?: {_WORD})?, (?:{_TITLE} )?{_WORD}(?: [{_UP}]\.)?)(?![\w@]))")
# An address is sought from its sign, to the left as far as its letters go, to the right by its expression.
_SIGN = re.compile(r"@|%40|\s?[(\[{]\s?(?:at|AT|arroba)\s?[)\]}]\s?| at ")
_LOCAL_LETTER = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+'-" + "".join(map(chr, range(0xC0, 0x100))))
_DOMAIN = re.compile(r"[A-Za-z0-9À-ÿ-]++(?:(?:\.|\s?[(\[{]\s?(?:dot|DOT|punto|punkt|point)\s?[)\]}]\s?| dot )[A-Za-z0-9-]++)+")
_PHONE = re.compile(r"(?<![\w/.@-])(?:\+|\(|\b)[\d(][\d ().\-/]{5,22}\d(?!\w)(?: ?(?:ext|x|extn|poste|Durchwahl|DW)\.? ?\d{1,5})?")
_IDS = tuple(
    re.compile(p)
    for p in (
        r"(?<![\w.-])\d{3}([-. ])\d{2}\1\d{4}(?![\w-]|\.\d)", r"(?<![\w.-])\d{9}(?![\w-])", r"(?<![\w.-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)", r"(?<![\w.-])\d{8}[- ]?[A-Z](?!\w)",
        r"(?<![\w.-])[XYZ][- ]?\d{7}[- ]?[A-Z](?!\w)", r"(?<![\w.-])[12] ?\d{2} ?\d{2} ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3}(?: ?\d{2})?(?![\w-])", r"(?<![\w.-])\d{11}(?![\w-])", r"(?<![\w.-])\d{2} \d{3} \d{3} \d{3}(?![\w-])",
        r"(?<![\w.-])[A-Z]\d{7,9}(?![\w-])", r"(?<![\w.-])\d{8}(?![\w-])", r"(?<![\w.+/=-])(?:(?=[A-Z0-9]*\d)[A-Z][A-Z0-9]{8}|[CFGHJK][CFGHJKLMNPRTVWXYZ0-9]{8})(?![\w+/=-])", r"(?<![\w.-])[A-Z]{6}\d{2}[A-EHLMPRST]\d{2}[A-Z]\d{3}[A-Z](?!\w)", r"(?<![\w.-])\d{6}[-+ A]\d{3,5}[A-Z\d]?(?![\w-])",
    )
)
_STREET = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Court|Ct|Close|Cl|Boulevard|Blvd|Way|Place|Pl|Terrace|Crescent|Square|Sq|Row|Walk|Hill|Gardens|Grove|Parkway|Pkwy|Circle|Highway|Hwy|Mews|Park|Green|Rise)"
_WHOLE = rf"(?>{_WORD})"
_ADDRESSES = (
    re.compile(rf"(?<![\w.])(?:(?:Flat|Apt|Unit|Suite) \d+[A-Za-z]?, )?\d{{1,5}}[A-Za-z]?,? (?:(?:[NSEW]|North|South|East|West|Old|New)\.? )?(?:{_WHOLE} ){{1,3}}{_STREET}\b\.?(?:,? (?:Apt|Flat|Unit|Suite|#) ?\w+)?"),
    re.compile(rf"(?<![\w.])\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?i:rue|avenue|av\.|boulevard|bd|chemin|place|impasse|allée|allee|cours|quai|route|square|passage|sentier|faubourg)(?: (?:de la|de l['’]|des|du|de|d['’]))? ?(?:{_WHOLE} ?){{1,4}}"),
    re.compile(rf"(?<![\w.])(?:(?:Am|An der|Zum|Zur|Im|In der|Auf der|Unter den) )?[{_UP}][{_LOW}{_UP}-]{{0,80}}(?:[ -]?(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|ufer|damm|chaussee|Straße|Str\.|Weg|Platz|Allee|markt|steig|hof))\.? \d{{1,4}} ?[a-z]?(?!\w)"),
    re.compile(rf"(?<![\w.])(?:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Pza\.?|Paseo|Pº|Camino|Carrera|Ronda|Travesía|Rambla|Carretera|Vía|Glorieta)(?: (?:de la|de los|de las|del|de))? ?(?:{_WHOLE} ?){{1,4}},? ?(?:n[.ºo°]+ ?|núm\. ?)?\d{{1,4}}(?:,? ?\d{{1,2}}[ºª](?: ?[A-Z])?)?"),
)
# Signs without which the expressions above cannot match a line; none reaches beyond it.
_DIGIT = re.compile(r"\d")
_MANY_DIGITS = re.compile(r"\d(?:[ ().\-/]{0,4}\d){6}")
_ID_LIKE = re.compile(r"\d(?:[ .-]?[A-Z0-9]){5}|[A-Z0-9]{8}")
_ENDINGS = "aße sse tr. weg Weg atz lee ing fer amm see rkt eig hof".split()
_ADDRESS_SIGNS = (
    re.compile(rf"\d[A-Za-z]?,? (?:[NSEW]\.? |(?:North|South|East|West|Old|New)\.? )?(?:[DdLO]['’])?[{_UP}]"),
    re.compile(r"\d(?: ?(?:bis|ter|quater))?,? (?i:rue|av|bo|bd|ch|pl|im|al|co|qu|ro|sq|pa|se|fa)"),
    re.compile(" (?:" + "|".join(f"(?<={'|'.join(re.escape(e) + dot for e in _ENDINGS)})" for dot in (" ", r"\. ")) + r")\d"),
    re.compile(r"(?:Calle|C/|Av|Plaza|Pza|P[aº]|Camino|Carre|Ronda|Travesía|Rambla|Vía|Glorieta)[^\n]*\d"),
)
# A word with a capital, read once from its beginning, and a capital not far behind it.
_TWO_NAMES = re.compile(rf"(?<![{_UP}{_LOW}.'’-])(?=[{_LOW}.'’-]*+[{_UP}])[{_UP}{_LOW}.'’-]*+,? (?:[a-z]++ (?:[a-z]++ )?)?(?:[DdLO]['’])?[{_UP}]")
_TITLED, _INITIAL, _OF = re.compile(rf"{_TITLE} "), re.compile(rf"(?<!\w)[{_UP}]\."), re.compile(rf" (?:{_PARTICLE}) ")
_ONLY_TITLE, _ONLY_INITIAL = re.compile(_TITLE), re.compile(rf"[{_UP}]\.")
_LOCAL, _LOGIN_PART = re.compile(r"[@(\[%]| at "), re.compile(r"[\d._+-]")
_NUMBERS, _SPACE = re.compile(r"\d+"), re.compile(r"\s")
_TOKEN = re.compile(r"[^\s\"'<>()\[\]{};,=:]+|[\"'<>()\[\]{};,=:]")
_LOGINS = frozenset("build deploy git root admin administrator noreply no-reply svc service user www backup ci bot jenkins ubuntu ec2-user postgres mysql reader app info support sales postmaster".split())
_COMMENT = re.compile(r"\s*(?:#|//|--|/\*|\*|;|<!--)")

NUMBERS = 31  # numeric features before the rates


def fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))


def _side(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c in "\"'`" else 3 if c in "<([{" else 4 if c in ":;=,." else 5 if c in "/@\\" else 6 if c.isalnum() or c == "_" else 7 if c in ">)]}" else 8


class _Kinds(dict):
    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = out = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        return out


_KINDS, _LONG_UPPER, _LONG_LOWER = _Kinds(), re.compile("A{2,}"), re.compile("a{2,}")


def _shape(s: str) -> str:
    return _LONG_UPPER.sub("A+", _LONG_LOWER.sub("a+", s.translate(_KINDS)))[:40]


def _checks(kind: int, pattern: int, s: str) -> int:
    """1 if a check digit holds, 0 if it fails, -1 where there is none."""
    d = re.sub(r"\W", "", s)
    if kind != 2:
        return -1
    if pattern == 3:
        return int("TRWAGMYFPDXBNJZSQVHLCKE"[int(d[:8]) % 23] == d[8])
    if pattern == 4:
        return int("TRWAGMYFPDXBNJZSQVHLCKE"[int("XYZ".index(d[0]).__str__() + d[1:8]) % 23] == d[8])
    if pattern == 5 and len(d) == 15 and d.isdigit():
        return int(97 - int(d[:13]) % 97 == int(d[13:]))
    if pattern in (6, 7):
        p = 10
        for c in d[:10]:
            p = (int(c) + p) % 10 or 10
            p = p * 2 % 11
        return int((11 - p) % 10 == int(d[10]))
    if pattern in (0, 1):
        return int(d[:3] not in ("000", "666") and d[3:5] != "00" and d[5:] != "0000")
    return -1


#: Signs without which a generator finds nothing on a line, and the generators' bits.
_EMAILS, _PHONES, _NUMBERS_OF_ID, _PLACES, _PERSONS = 1, 2, 4, 8, 128
_SIGNS = (
    (_EMAILS, re.compile(r"@|%40|[(\[{]\s?(?:at|AT|arroba)| at ")), (_PHONES, _MANY_DIGITS), (_NUMBERS_OF_ID, _ID_LIKE), *((_PLACES << k, sign) for k, sign in enumerate(_ADDRESS_SIGNS)), (_PERSONS, _TWO_NAMES),
)
EVERY = sum(bit for bit, _ in _SIGNS)


def flagged_lines(text: str) -> list[tuple[int, str, int]]:
    """(place, line, bits of the generators whose sign it has) of the lines that have any; the text is read once for each sign."""
    bits: dict[int, int] = defaultdict(int)
    for bit, sign in _SIGNS:
        at = 0
        while m := sign.search(text, at):
            bits[text.rfind("\n", at, m.start()) + 1 or at] |= bit
            at = text.find("\n", m.start()) + 1
            if not at:
                break
    return [(at, text[at : None if (end := text.find("\n", at)) < 0 else end], b) for at, b in sorted(bits.items())]


def candidates(line: str, names: frozenset[str], wanted: int = EVERY) -> list[tuple[int, int, int, int]]:
    """(start, end, type, pattern) of the spans that may be personal information."""
    out: list[tuple[int, int, int, int]] = []
    if wanted & _EMAILS:
        done = 0
        for m in _SIGN.finditer(line):
            start = m.start()
            while start > done and line[start - 1] in _LOCAL_LETTER:
                start -= 1
            if done <= start < m.start() and (d := _DOMAIN.match(line, m.end())):
                done = d.end()
                out.append((start, done, 0, 0))
    if wanted & _PHONES:
        for m in _PHONE.finditer(line):
            n = len(_DIGIT.findall(m.group()))
            if 7 <= n <= 16:
                out.append((m.start(), m.end(), 1, 0))
    if wanted & _NUMBERS_OF_ID:
        for k, p in enumerate(_IDS):
            out += [(m.start(), m.end(), 2, k) for m in p.finditer(line)]
    for k, p in enumerate(_ADDRESSES):
        if wanted & _PLACES << k:
            out += [(m.start(), m.start() + len(m.group().rstrip()), 3, k) for m in p.finditer(line)]
    if not wanted & _PERSONS:
        return out
    for m in _RUN.finditer(line):
        tokens = m.group().split(" ")
        if len(tokens) < 2:
            continue
        out.append((m.start(), m.end(), 4, 0))
        at = m.start()
        for i, t in enumerate(tokens[:-1]):
            if i and (fold(t) in names or _ONLY_TITLE.fullmatch(t) or _ONLY_INITIAL.fullmatch(t)):
                out.append((at, m.end(), 4, 1))
                break
            at += len(t) + 1
    out += [(m.start(1), m.end(1), 4, 2) for m in _COMMA.finditer(line)]
    return out


class Around:
    """What the features of all spans of a line need to know of the line, found once."""

    def __init__(self, line: str, spans: list[tuple[int, int, int, int]]) -> None:
        self.line = line
        self.url, self.key, self.comment = "://" in line, line.lstrip().startswith("ssh-"), bool(_COMMENT.match(line))
        first = _TOKEN.search(line)
        self.first = _NUMBERS.sub("0", first.group()[:40].lower()) if first else ""
        self.begin = len(line) - len(line.lstrip())
        self.schemes = [m.start() for m in re.finditer("://", line) if self._scheme(m.start())] if self.url else []
        self.copies = Counter(spans)
        self.edges = {k: (sorted(s[0] for s in spans if s[2] == k), sorted(s[1] for s in spans if s[2] == k)) for k in {s[2] for s in spans}}

    def _scheme(self, at: int) -> bool:
        while at and (c := self.line[at - 1]).isascii() and (c.islower() or c.isdigit() or c in "+.-"):
            at -= 1
            if c.islower():
                return True
        return False

    def in_url(self, start: int) -> bool:
        """Whether an address begins before the place without white space in between."""
        i = bisect_right(self.schemes, start - 3)
        return i > 0 and not _SPACE.search(self.line, self.schemes[i - 1], start)

    def crossing(self, start: int, end: int, kind: int) -> int:
        starts, ends = self.edges.get(kind, ((), ()))
        return bisect_left(starts, end) - bisect_right(ends, start)


def features(span: tuple[int, int, int, int], around: Around, names: frozenset[str]) -> tuple[list[float], list[str]]:
    """Numbers about the span's format and place, and the words around it whose rates are learned."""
    start, end, kind, pattern = span
    line = around.line
    s = line[start:end]
    tokens = s.split()
    folded = [fold(t.strip(",.")) for t in tokens]
    left = _TOKEN.findall(line[max(0, start - 80) : start])
    right = _TOKEN.findall(line[end : end + 60])
    words = [_NUMBERS.sub("0", w.lower()) for w in left if w[0].isalnum()]
    local = _LOCAL.split(s)[0].strip().lower()
    last_before = start
    while last_before and line[last_before - 1].isspace():
        last_before -= 1
    same = around.crossing(start, end, kind)
    other = sum(around.crossing(start, end, k) for k in around.edges) - same
    numbers = [
        kind, pattern, len(s), sum(map(str.isdigit, s)), sum(map(str.isupper, s)), sum(not c.isalnum() and not c.isspace() for c in s), len(tokens),
        bool(folded) and folded[0] in names, sum(t in names for t in folded), bool(_TITLED.match(s)), bool(_INITIAL.search(s)), bool(_OF.search(s)),
        ", " in s, sum(len(t) > 2 and t.isupper() for t in tokens), _checks(kind, pattern, s), _side(line[max(0, start - 1) : start]), _side(line[end : end + 1]), around.url, around.key, s.count("@"),
        around.comment, len(right) > 0 and right[0] == ":", start <= around.begin, other, same - around.copies[span],
        _LOGIN_PART.split(local)[0] in _LOGINS, around.in_url(start), line[max(0, last_before - 1) : last_before] == ":", start, sum(t[:1].isupper() for t in tokens) / max(1, len(tokens)), line[end : end + 1] == ":" or line[end : end + 2] == ":/",
    ]
    last, shape = folded[-1] if folded else "", _shape(s)
    texts = [
        words[-1] if words else (left[-1] if left else "^"), " ".join(words[-2:]), "".join(left[-2:])[-20:].lower(), (_NUMBERS.sub("0", right[0].lower()) if right else "$"), shape, folded[0][:40] if folded and kind > 2 else "", last[-4:] if kind > 2 else last[-8:],
        around.first, " ".join(words[-1:]) + "|" + shape[:16],
    ]
    return [float(n) for n in numbers], [f"{kind}|{t}" for t in texts]


TEXTS = 9


def proposals(text: str, names: frozenset[str]) -> list[tuple[int, int, int, list[float], list[str]]]:
    """(start, end, type, numbers, texts) over the original text."""
    clean, out = Clean(text), []
    for at, line, wanted in flagged_lines(clean.text):
        spans = candidates(line, names, wanted)
        around = Around(line, spans) if spans else None
        for c in spans:
            numbers, texts = features(c, around, names)
            s, e = clean.span(at + c[0], at + c[1])
            out.append((s, e, c[2], numbers, texts))
    return out


class Rates:
    """Smoothed share of reported cases by word."""

    def __init__(self, texts: list[list[str]], y: np.ndarray, prior: dict[str, float]) -> None:
        n: list[dict[str, list[float]]] = [defaultdict(lambda: [0.0, 0.0]) for _ in range(TEXTS)]
        for row, label in zip(texts, y):
            for j, t in enumerate(row):
                cell = n[j][t]
                cell[0] += label
                cell[1] += 1
        self.prior = prior
        self.tables = [{t: (p + 4 * prior.get(t.partition("|")[0], 0.1)) / (k + 4) for t, (p, k) in table.items() if k >= 2} for table in n]

    def columns(self, texts: list[list[str]]) -> np.ndarray:
        out = np.empty((len(texts), TEXTS))
        for i, row in enumerate(texts):
            for j, t in enumerate(row):
                v = self.tables[j].get(t)
                out[i, j] = self.prior.get(t.partition("|")[0], 0.1) if v is None else v
        return out


class Model:
    """Rates, trees, and for each type a calibration and the score from which a span is taken."""

    def __init__(self, numbers: np.ndarray, texts: list[list[str]], y: np.ndarray, fold_of: np.ndarray) -> None:
        kinds = numbers[:, 0].astype(int)
        prior = {str(k): float(y[kinds == k].mean()) if (kinds == k).any() else 0.1 for k in range(len(TYPES))}
        held, coded = np.zeros(len(y)), np.zeros((len(y), TEXTS))
        for f in (0, 1):  # rates of the one half serve the other, so no case tells its own label
            rest, own = np.flatnonzero(fold_of != f), np.flatnonzero(fold_of == f)
            coded[own] = Rates([texts[i] for i in rest], y[rest], prior).columns([texts[i] for i in own])
        x = np.hstack([numbers, coded])
        for f in (0, 1):
            rest, own = fold_of != f, fold_of == f
            held[own] = boosting.fit(x[rest], y[rest]).probability(x[own])
        self.rates, self.trees = Rates(texts, y, prior), boosting.fit(x, y)
        self.calibrations, self.least = [], []
        for k in range(len(TYPES)):
            own = kinds == k
            c = boosting.calibrate(held[own], y[own])
            shares = c(held[own])
            true = shares[y[own] > 0]
            self.calibrations.append(c)
            # Reported cases are a sample of the true ones: half of the share that they reach on average.
            self.least.append(0.5 * float(true.mean()) if len(true) else 0.5)

    def chosen(self, found: list[list[tuple]]) -> list[list[tuple[int, int, str]]]:
        """The spans taken of each text's proposals, ordered and without overlaps."""
        flat = [p for f in found for p in f]
        if not flat:
            return [[] for _ in found]
        x = np.hstack([np.array([p[3] for p in flat]), self.rates.columns([p[4] for p in flat])])
        raw = self.trees.probability(x)
        kinds = x[:, 0].astype(int)
        score = np.empty(len(raw))
        for k in range(len(TYPES)):
            own = kinds == k
            score[own] = self.calibrations[k](raw[own]) / max(self.least[k], 1e-6)
        out, at = [], 0
        for f in found:
            own = sorted(((-score[at + i], -(p[1] - p[0]), p[0], p[1], p[2]) for i, p in enumerate(f) if score[at + i] >= 1), key=lambda t: t)
            taken: list[tuple[int, int, str]] = []  # ordered and disjoint, so only neighbours can cross
            for _, _, s, e, k in own:
                at_ = bisect_left(taken, (s, e))
                if (not at_ or taken[at_ - 1][1] <= s) and (at_ == len(taken) or e <= taken[at_][0]):
                    taken.insert(at_, (s, e, TYPES[k]))
            out.append(taken)
            at += len(f)
        return out


def _folded(given_names: DataFrame) -> DataFrame:
    return given_names.where("given_name is not null").select(F.pandas_udf(lambda s: s.map(fold), "string")("given_name")).distinct()


def fit_model(requests: DataFrame, reports: DataFrame, given_names: DataFrame, key: str = "scan_id", text: str = "text") -> Model:
    """Fits on at most TRAINING_REQUESTS requests, the first by a hash of their key; all of a smaller table."""
    spark = requests.sparkSession
    q = requests.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null and t <> ''")
    ids = q.select("k").distinct().orderBy(F.xxhash64("k"), "k").limit(TRAINING_REQUESTS)  # texts are not moved for the choice
    q = q.join(F.broadcast(ids), "k", "left_semi").groupBy("k").agg(F.max("t").alias("t"))
    r = reports.select(F.col(key).alias("k"), "start_pos", "end_pos", "entity_type").where("start_pos is not null and end_pos is not null").where(F.col("entity_type").isin(list(REPORTED))).distinct()
    r = r.join(F.broadcast(ids), "k", "left_semi").groupBy("k").agg(F.collect_list(F.struct("start_pos", "end_pos", "entity_type")).alias("told"))
    x = q.join(r, "k", "left").withColumn("half", F.pmod(F.xxhash64(F.lit(1), "k"), F.lit(2)).cast("int"))
    x, names_of = with_vocabulary(x, _folded(given_names), MAX_NAMES, proposals)

    def label(batches):
        for p in batches:
            rows = []
            for t, told, half, names in zip(p["t"], p["told"], p["half"], names_of(p)):
                marks = [(m["start_pos"], m["end_pos"], REPORTED[m["entity_type"]]) for m in (told if told is not None else [])]
                for s, e, k, numbers, texts in proposals(t, names):
                    hit = any(kind == TYPES[k] and 2 * (min(e, b) - max(s, a)) > (min if k == 3 else max)(e - s, b - a) for a, b, kind in marks)
                    rows.append((half, float(hit), numbers, texts))
            yield pd.DataFrame(rows, columns=["half", "y", "numbers", "texts"])

    got = x.repartition(spark.sparkContext.defaultParallelism).mapInPandas(label, "half int, y double, numbers array<double>, texts array<string>").toArrow()
    numbers = got["numbers"].combine_chunks()
    flat = np.asarray(numbers.flatten() if len(got) else [], float).reshape(len(got), -1) if len(got) else np.zeros((0, NUMBERS))
    texts = got["texts"].to_pylist()
    order = sorted(range(len(texts)), key=lambda i: (texts[i], flat[i].tolist()))
    y, half = np.asarray(got["y"].to_pylist(), float), np.asarray(got["half"].to_pylist(), int)
    return Model(flat[order], [texts[i] for i in order], y[order], half[order])


def find_personal(requests: DataFrame, reports: DataFrame, given_names: DataFrame, key: str = "scan_id", text: str = "text", redact: bool = False) -> DataFrame:
    """(key, line_no, start_pos, end_pos, entity_type) of each item, or (key, text, n_items) with ``redact``.

    ``reports`` has the key, start_pos, end_pos and entity_type; ``given_names`` has given_name. Null and empty texts have
    no item and are redacted to themselves; without any report nothing is taken. Places count code points of the text as
    it is, lines count from 1 and end at a newline. Repeated rows give their items again.
    """
    spark = requests.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(fit_model(requests, reports, given_names, key, text))
    x, names_of = with_vocabulary(spread(requests.select(F.col(key).alias("k"), F.col(text).alias("t"))), _folded(given_names), MAX_NAMES, proposals)
    kind = x.schema["k"].dataType.simpleString()

    def spans(p):
        return shared.value.chosen([proposals(t, names) if t else [] for t, names in zip(p["t"], names_of(p))])

    def search(batches):
        for p in batches:
            at, rows = [], []
            for i, (t, found) in enumerate(zip(p["t"], spans(p))):
                line, upto = 1, 0
                for s, e, k in found:
                    line, upto = line + t.count("\n", upto, s), s
                    at.append(i)
                    rows.append((line, s, e, k))
            out = pd.DataFrame(rows, columns=["line_no", "start_pos", "end_pos", "entity_type"])
            out.insert(0, "k", p["k"].to_numpy()[at])
            yield out

    def clean(batches):
        for p in batches:
            texts, counts = [], []
            for t, found in zip(p["t"], spans(p)):
                parts, at = [], 0
                for s, e, k in found:
                    parts += [t[at:s], f"[{k}]"]
                    at = e
                texts.append("".join([*parts, t[at:]]) if found else t), counts.append(len(found))
            yield pd.DataFrame({"k": p["k"], "t": texts, "n": counts})

    if redact:
        return x.mapInPandas(clean, f"k {kind}, t string, n int").toDF(key, text, "n_items")
    return x.mapInPandas(search, f"k {kind}, line_no bigint, start_pos int, end_pos int, entity_type string").withColumnRenamed("k", key)
