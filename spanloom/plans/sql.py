"""What scans and checks mean in SQL, for engines without look-around: the second opinion on the catalogs and the engine."""

from __future__ import annotations

import re

from spanloom.catalog import prompts
from spanloom.catalog.model import CONTEXT_BOOST, Rule, _spaces
from spanloom.functions import checksums, similarity
from spanloom.operators import guards
from spanloom.plans.policy import RiskThresholds

# --- check digits ----------------------------------------------------------------------------------------------------


def digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '', 'g')"


def _at(d: str, i: int) -> str:
    return f"CAST(substr({d}, {i + 1}, 1) AS INTEGER)"


def dot(d: str, weights, start: int = 0) -> str:
    return "(" + " + ".join(f"{_at(d, start + i)} * {w}" for i, w in enumerate(weights)) + ")"


def luhn(d: str) -> str:
    r = f"string_split(reverse({d}), '')"
    return f"(length({d}) > 0 AND list_sum(list_transform({r}, lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) WHEN CAST(c AS INTEGER) * 2 > 9 THEN CAST(c AS INTEGER) * 2 - 9 ELSE CAST(c AS INTEGER) * 2 END)) % 10 = 0)"


def _distinct(d: str) -> str:
    return f"len(list_distinct(string_split({d}, '')))"


def _folded(x: str) -> str:
    return f"(CASE WHEN {x} * 2 > 9 THEN {x} * 2 - 9 ELSE {x} * 2 END)"


def verhoeff(n: str) -> str:
    d, p = ("[" + ", ".join(str(c) for row in t for c in row) + "]" for t in (checksums.VERHOEFF_D, checksums.VERHOEFF_P))
    each = f"list_transform(string_split(reverse(CAST({n} AS VARCHAR)), ''), lambda c, i: {p}[((i - 1) % 8) * 10 + CAST(c AS INTEGER) + 1])"
    return f"(list_reduce([0] || {each}, lambda a, x: {d}[a * 10 + x + 1]) = 0)"


def _letter(n: str, letters: str = checksums.NIF_LETTERS) -> str:
    return f"substr('{letters}', CAST(CAST({n} AS BIGINT) % {len(letters)} + 1 AS INTEGER), 1)"


def _fiscal(u: str) -> str:
    chars = "".join(checksums.FISCAL_ODD)
    odd, even = list(checksums.FISCAL_ODD.values()), [int(c) if c.isdigit() else ord(c) - 65 for c in chars]
    total = " + ".join(f"{odd if i % 2 == 0 else even}[strpos('{chars}', substr({u}, {i + 1}, 1))]" for i in range(15))
    return f"regexp_full_match({u}, '[0-9A-Z]{{16}}') AND chr(CAST(65 + ({total}) % 26 AS INTEGER)) = substr({u}, 16, 1)"


def check(name: str, t: str) -> str:
    """The named check of a value as a condition; a value of another form fails."""
    d = digits(t)
    bare = f"replace({t}, '-', '')"
    compact = rf"regexp_replace({t}, '[\s-]', '', 'g')"
    sized = lambda n, test, of=d: f"CASE WHEN length({of}) = {n} THEN {test} ELSE false END"
    last10 = f"right(regexp_replace({t}, '[-+]', '', 'g'), 10)"
    s = f"upper({compact})"
    turned = f"string_split(substr({s}, 5) || left({s}, 4), '')"
    tail, tnin = f"substr({compact}, 3)", dot(d, range(13, 1, -1))
    prefixes = " AND ".join(f"NOT starts_with({d}, '{p}')" for p in checksums.SSN_PREFIXES)
    return {
        "luhn": luhn(d),
        "iban": f"CASE WHEN regexp_full_match({s}, '[0-9A-Z]{{4,}}') THEN list_reduce([0] || list_transform({turned}, lambda c: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1), lambda r, v: CASE WHEN v > 9 THEN (r * 100 + v) % 97 ELSE (r * 10 + v) % 97 END) = 1 ELSE false END",
        "ssn": f"(length({d}) = 9 AND {_distinct(d)} > 1 AND substr({d}, 4, 2) <> '00' AND substr({d}, 6, 4) <> '0000' AND substr({d}, 1, 1) <> '9' AND {prefixes})",
        "mac": f"(regexp_full_match(upper(regexp_replace({t}, '[:.-]', '', 'g')), '[0-9A-F]{{12}}') AND upper(regexp_replace({t}, '[:.-]', '', 'g')) NOT IN ('FFFFFFFFFFFF', '000000000000'))",
        "npi": sized(10, f"{_distinct(f'left({d}, 9)')} > 1 AND {luhn(f'(80840 || {d})')}"),
        "dea": f"CASE WHEN regexp_full_match({tail}, '[0-9]{{7}}') THEN (2 * {dot(tail, (1, 0, 1, 0, 1, 0))} + {dot(tail, (0, 1, 0, 1, 0, 1))} - {_at(tail, 6)}) % 10 = 0 ELSE false END",
        "nif": f"CASE WHEN {d} <> '' THEN {_letter(d)} = right({bare}, 1) ELSE false END",
        "nie": f"CASE WHEN regexp_full_match({bare}, '[XYZ][0-9]{{6,7}}.') THEN {_letter(f'''((strpos('XYZ', left({bare}, 1)) - 1)::VARCHAR || substr({bare}, 2, length({bare}) - 2))''')} = right({bare}, 1) ELSE false END",
        "fiscal": f"CASE WHEN length({t}) = 16 THEN {_fiscal(f'upper({t})')} ELSE false END",
        "vat": sized(11, f"{d} <> '00000000000' AND ({' + '.join(_at(d, i) for i in range(0, 11, 2))} + {' + '.join(_folded(_at(d, i)) for i in range(1, 10, 2))}) % 10 = 0"),
        "pesel": sized(11, f"{dot(d, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3))} % 10 = {_at(d, 10)}"),
        "hetu": f"CASE WHEN regexp_full_match({t}, '[0-9]{{6}}.[0-9]{{3}}.') THEN {_letter(f'(left({t}, 6) || substr({t}, 8, 3))', checksums.HETU_LETTERS)} = right({t}, 1) ELSE false END",
        "personnummer": f"CASE WHEN regexp_full_match({last10}, '[0-9]{{10}}') THEN CAST(substr({last10}, 3, 2) AS INTEGER) BETWEEN 1 AND 12 AND (CAST(substr({last10}, 5, 2) AS INTEGER) BETWEEN 1 AND 31 OR CAST(substr({last10}, 5, 2) AS INTEGER) BETWEEN 61 AND 91) AND {luhn(last10)} ELSE false END",
        "steuer": sized(11, f"{_distinct(f'left({d}, 10)')} > 1 AND (11 - list_reduce([10] || list_transform(string_split(left({d}, 10), ''), lambda c: CAST(c AS INTEGER)), lambda p, x: (CASE WHEN (x + p) % 10 = 0 THEN 10 ELSE (x + p) % 10 END) * 2 % 11)) % 10 = {_at(d, 10)}"),
        "abn": sized(11, f"((CASE WHEN left({d}, 1) = '0' THEN 9 ELSE {_at(d, 0)} - 1 END) * 10 + {dot(d, (1, 3, 5, 7, 9, 11, 13, 15, 17, 19), 1)}) % 89 = 0"),
        "acn": sized(9, f"(10 - {dot(d, (8, 7, 6, 5, 4, 3, 2, 1))} % 10) % 10 = {_at(d, 8)}"),
        "au_medicare": sized(10, f"{dot(d, (1, 3, 7, 9, 1, 3, 7, 9))} % 10 = {_at(d, 8)}"),
        "aadhaar": sized(12, f"left({d}, 1) >= '2' AND {d} <> reverse({d}) AND {verhoeff(f'CAST({d} AS BIGINT)')}"),
        "nin": f"CASE WHEN regexp_full_match({t}, '[0-9]{{11}}') THEN {verhoeff(f'CAST({t} AS BIGINT)')} ELSE false END",
        "rrn": sized(13, f"CAST(substr({d}, 8, 2) AS INTEGER) <= 95 AND (11 - {dot(d, (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5))} % 11) % 10 = {_at(d, 12)}"),
        "tnin": sized(13, f"(CASE WHEN {tnin} % 11 <= 1 THEN 1 - {tnin} % 11 ELSE 11 - {tnin} % 11 END) = {_at(d, 12)}"),
        "aba": sized(9, f"{dot(d, checksums.WEIGHTS['aba'])} % 10 = 0"), "nhs": sized(10, f"{dot(d, checksums.WEIGHTS['nhs'])} % 11 = 0"), "tfn": sized(9, f"{dot(d, checksums.WEIGHTS['tfn'])} % 11 = 0"),
        "sentinel_year": f"CASE WHEN regexp_matches({t}, '^[0-9]{{4}}') THEN CAST(left({t}, 4) AS INTEGER) NOT BETWEEN 1900 AND 2100 ELSE false END",
    }[name]


def entropy(v: str) -> str:
    share = f"len(list_filter(string_split({v}, ''), lambda y: y = x))::DOUBLE / length({v})"
    return f"(CASE WHEN length({v}) = 0 THEN 0.0 ELSE -list_sum(list_transform(list_distinct(string_split({v}, '')), lambda x: {share} * log2({share}))) END)"


# --- expressions -----------------------------------------------------------------------------------------------------


def literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def expression(pattern: str, ignore_case: bool = False) -> str:
    """The expression in the other dialect, as a string literal."""
    p = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", _spaces(pattern)).replace("\\/", "/")
    return literal(("(?i)" if ignore_case else "") + p)


def without_look_around(rule: Rule, pattern: str) -> tuple[str, str, str]:
    """(expression, the match in what it finds (m), condition on the match (t) and the characters around it (a, z))."""
    p = pattern
    if rule.entity_type == "CREDIT_CARD":
        return p.replace(r"(?!1\d{12}(?!\d))", ""), "m", "NOT regexp_matches(t, '^1[0-9]{12}$')"
    if rule.entity_type == "IBAN_CODE":  # its end is found with the character behind it
        return re.sub(r"\(\?[<!=]+\[A-Z0-9\]\)", "", p) + "(?:[^A-Z0-9]|$)", "CASE WHEN regexp_matches(right(m, 1), '[A-Z0-9]') THEN m ELSE left(m, length(m) - 1) END", "NOT regexp_matches(a, '[A-Z0-9]')"
    if rule.entity_type == "MAC_ADDRESS" and r"\1" in p:
        return "|".join(p.replace("([:-])", c).replace(r"\1", c) for c in ":-"), "m", "true"
    if rule.entity_type == "UK_NINO":
        return p.replace("(?!BG|GB|NK|KN|NT|TN|ZZ)", ""), "m", "upper(left(t, 2)) NOT IN ('BG', 'GB', 'NK', 'KN', 'NT', 'TN', 'ZZ')"
    if rule.entity_type in ("KR_RRN", "KR_PASSPORT"):
        before = "[0-9]" if rule.entity_type == "KR_RRN" else "[A-Za-z0-9]"
        return re.sub(r"\(\?[<!=]+(?:\[A-Z0-9\]|\\d)\)", "", p), "m", f"NOT regexp_matches(a, '{before}') AND NOT regexp_matches(z, '[0-9]')"
    if rule.entity_type == "AWS_ACCESS_KEY":  # a whole run of such characters
        return "[A-Z0-9]{20,}", "m", "length(t) = 20 AND starts_with(t, 'AKIA')"
    if rule.entity_type == "AWS_SECRET_KEY":
        return "[A-Za-z0-9/+=]{40,}", "m", "length(t) = 40"
    return p, "m", "true"


# --- scans -----------------------------------------------------------------------------------------------------------


def scan(source: str, rules: tuple[Rule, ...], guard: str, threshold: float | None, disposition: str = "confirmed", name: str = "s") -> str:
    """CTEs that end with ``name`` (k, body, entity_type, start_pos, end_pos, text, confidence, score, guard_name, disposition, ord).

    ``source`` is a query of k and body without nulls.
    """
    found, values = [], []
    for i, r in enumerate(rules):
        boosted = min(1.0, r.score + CONTEXT_BOOST)
        values.append(f"({i}, '{r.entity_type}', {r.score}::DOUBLE, {boosted!r}::DOUBLE, '{r.confidence}', '{guards.promoted(r.confidence)}', [{', '.join(map(literal, r.words))}]::VARCHAR[])")
        for j, p in enumerate(r.patterns):
            pattern, match, condition = without_look_around(r, p)
            e = expression(pattern, r.ignore_case)
            if r.validator:
                condition += f" AND ({check(r.validator, 't')})"
            if r.min_entropy is not None:
                v = f"(CASE WHEN regexp_extract(t, {e}, 1) <> '' THEN regexp_extract(t, {e}, 1) ELSE t END)" if re.compile(p).groups else "t"
                condition += f" AND {entropy(v)} >= {r.min_entropy}"
            found.append(f"""SELECT {i} AS rule, {j} AS pat, k, body, start_pos, t FROM (SELECT *, substr(body, start_pos, CASE WHEN start_pos > 0 THEN 1 ELSE 0 END) AS a, substr(body, start_pos + length(t) + 1, 1) AS z FROM (
                SELECT k, body, {match} AS t, start_pos FROM (SELECT k, body, ms[i] AS m, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS start_pos
                FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT k, body, regexp_extract_all(body, {e}) AS ms, string_split_regex(body, {e}) AS ps FROM {name}_t WHERE regexp_matches(body, {e})))))) WHERE {condition}""")
    kept = "" if threshold is None else f"WHERE score >= {threshold}"
    return f"""{name}_t AS ({source}), {name}_m AS ({" UNION ALL ".join(found)}), {name}_r(rule, entity_type, low, high, conf, conf_high, words) AS (VALUES {", ".join(values)}),
        {name}_c AS (SELECT m.*, r.*, len(list_filter(words, lambda x: contains(lower(substr(body, greatest(0, start_pos - 100) + 1, start_pos + length(t) + 100 - greatest(0, start_pos - 100))), x))) > 0 AS near FROM {name}_m m JOIN {name}_r r USING (rule)),
        {name}_k AS (SELECT k, body, rule, pat, entity_type, start_pos, CAST(start_pos + length(t) AS INTEGER) AS end_pos, t AS text, CASE WHEN near THEN conf_high ELSE conf END AS confidence, CASE WHEN near THEN high ELSE low END AS score FROM {name}_c),
        {name} AS (SELECT k, body, entity_type, start_pos, end_pos, text, confidence, score, '{guard}' AS guard_name, '{disposition}' AS disposition, CAST(row_number() OVER (PARTITION BY k ORDER BY rule, pat, start_pos) - 1 AS INTEGER) AS ord FROM {name}_k {kept})"""


def disjoint(of: str, name: str) -> str:
    """CTEs that end with ``name``: of the rows of ``of`` with one k the best scores first, each if it overlaps none taken."""
    return f"""{name}_l AS (SELECT k, list({{'s': start_pos, 'e': end_pos, 'o': ord}} ORDER BY score DESC, ord) AS xs FROM {of} GROUP BY k),
        {name}_b AS (SELECT k, list_reduce(list_transform(xs, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.s < x[1].e AND y.e > x[1].s)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM {name}_l),
        {name} AS (SELECT o.* FROM {of} o JOIN (SELECT k, unnest(kept).o AS ord FROM {name}_b) b USING (k, ord))"""


def _likeness(source: str, phrases: tuple[str, ...], windows: bool, name: str) -> str:
    """CTEs that end with ``name`` (k, best): the highest likeness to a phrase."""
    low = "lower(trim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))"
    bare = r"regexp_replace(part, '\s+', '', 'g')"
    more = f"UNION ALL SELECT k, w, substr(low, CAST(w AS INTEGER) + 1, {similarity.WINDOW}) FROM (SELECT k, low, unnest(range(0, length(low) - {similarity.WINDOW} + 1, {similarity.STEP})) AS w FROM {name}_t WHERE length(low) > {similarity.WHOLE_UP_TO})" if windows else ""
    pairs = lambda s: f"unnest(list_transform(range(1, length({s})), lambda i: substr({s}, CAST(i AS INTEGER), 2)))"
    values = ", ".join(f"({i}, regexp_replace({literal(p)}, '\\s+', '', 'g'))" for i, p in enumerate(phrases))
    return f"""{name}_t AS (SELECT k, {low} AS low FROM ({source})), {name}_p AS (SELECT k, -1 AS w, low AS part FROM {name}_t {more}), {name}_s AS (SELECT k, w, {bare} AS s FROM {name}_p),
        {name}_g AS (SELECT k, w, length(s) AS n, pair, count(*) AS c FROM (SELECT k, w, s, {pairs("s")} AS pair FROM {name}_s WHERE length(s) > 1) GROUP BY ALL),
        {name}_f(phrase, s) AS (VALUES {values}), {name}_h AS (SELECT phrase, length(s) AS m, pair, count(*) AS c FROM (SELECT phrase, s, {pairs("s")} AS pair FROM {name}_f) GROUP BY ALL),
        {name}_d AS (SELECT k, w, phrase, 2 * sum(least(g.c, h.c)) / (n + m - 2) AS rating FROM {name}_g g JOIN {name}_h h USING (pair) GROUP BY k, w, phrase, n, m),
        {name} AS (SELECT k, max(rating)::DOUBLE AS best FROM {name}_d GROUP BY k)"""


def prompt_guard(source: str, kind: str, threshold: float, name: str) -> str:
    """CTEs that end with ``name``, like ``scan``: expressions, and likeness for texts in which they find nothing."""
    rules, phrases, windows = (prompts.INJECTION_RULES, prompts.INJECTION_PHRASES, True) if kind == "injection" else (prompts.LEAKAGE_RULES, prompts.LEAKAGE_PHRASES, False)
    return f"""{scan(source, rules, kind, None, name=name + "_x")}, {_likeness(source, phrases, windows, name + "_y")},
        {name} AS (SELECT * FROM {name}_x UNION ALL SELECT t.k, t.body, '{rules[0].entity_type}', 0, CAST(length(t.body) AS INTEGER), left(t.body, 200), CASE WHEN best >= 0.8 THEN 'high' ELSE 'medium' END, best, '{kind}', 'confirmed', 0
            FROM {name}_x_t t JOIN {name}_y USING (k) WHERE best >= {threshold} AND t.k NOT IN (SELECT k FROM {name}_x))"""


def engine(source: str, pii: tuple[Rule, ...], pii_at: float, secret: tuple[Rule, ...], secret_at: float, prompt_at: float, name: str = "d") -> str:
    """CTEs that end with ``name``: the findings of all guards, with the guards' order as ``g``."""
    return f"""{scan(source, pii, "pii", pii_at, name="p")}, {disjoint("p", "pd")}, {scan(source, secret, "secret", secret_at, name="c")}, {prompt_guard(source, "injection", prompt_at, "i")}, {prompt_guard(source, "leakage", prompt_at, "l")},
        {scan(source, prompts.TESTDATA_RULES, "testdata", None, "informational", "q")}, {disjoint("q", "qd")},
        {name} AS (SELECT 0 AS g, * FROM pd UNION ALL SELECT 1, * FROM c UNION ALL SELECT 2, * FROM i UNION ALL SELECT 3, * FROM l UNION ALL SELECT 4, * FROM qd)"""


def redacted(of: str, texts: str, name: str) -> str:
    """CTEs that end with ``name`` (k, redacted) of the texts (k, body): overlapping rows of ``of`` are one, of the first's type."""
    return f"""{name}_o AS (SELECT *, max(end_pos) OVER (PARTITION BY k ORDER BY start_pos, end_pos DESC, entity_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM {of}),
        {name}_n AS (SELECT *, sum(CASE WHEN upto IS NULL OR start_pos >= upto THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY start_pos, end_pos DESC, entity_type ROWS UNBOUNDED PRECEDING) AS part FROM {name}_o),
        {name}_u AS (SELECT k, part, min(start_pos) AS s, max(end_pos) AS e, first(entity_type ORDER BY start_pos, end_pos DESC, entity_type) AS kind FROM {name}_n GROUP BY k, part),
        {name}_v AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY k ORDER BY part), 0) AS before FROM {name}_u),
        {name}_w AS (SELECT v.k, string_agg(substr(body, CAST(before AS INTEGER) + 1, CAST(s - before AS INTEGER)) || '[REDACTED-' || kind || ']', '' ORDER BY part) AS head, max(e) AS e FROM {name}_v v JOIN ({texts}) t USING (k) GROUP BY v.k),
        {name} AS (SELECT t.k, CASE WHEN w.k IS NULL THEN t.body ELSE head || substr(t.body, CAST(e AS INTEGER) + 1) END AS redacted FROM ({texts}) t LEFT JOIN {name}_w w USING (k))"""


def levels(score: str, t: RiskThresholds) -> str:
    return f"CASE WHEN {score} >= {t.critical} THEN 'critical' WHEN {score} >= {t.high} THEN 'high' WHEN {score} >= {t.medium} THEN 'medium' WHEN {score} >= {t.low} THEN 'low' ELSE 'none' END"
