"""Credentials embedded in source code, configuration and prose.

A text is scanned for known token shapes, named values, headers, connection strings, command lines and key blocks. Encoded
literals (base64, hex, percent and backslash escapes) are decoded, layer by layer until nothing is left to decode (each
layer is shorter than the one around it); a decoded container of a private key is told by its binary grammar, decoded text
is scanned again, and a finding inside redacts the literal that encloses it.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame

from spanloom.llm import keyfiles
from spanloom.runtime import ship, spread

#: Shapes of tokens that tell their issuer.
TOKENS = {
    "AWS_ACCESS_KEY": r"(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}",
    "GITHUB_TOKEN": r"gh[pousr]_[A-Za-z0-9]{30,255}|github_pat_[A-Za-z0-9_]{40,255}",
    "GITLAB_TOKEN": r"gl(?:pat|dt|ptt|rt|soat|cbt)-[A-Za-z0-9_-]{20,60}",
    "SLACK_TOKEN": r"xox[abeoprs]-[A-Za-z0-9-]{20,250}|xapp-[0-9]-[A-Za-z0-9-]{20,250}",
    "STRIPE_KEY": r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,250}|whsec_[A-Za-z0-9+/]{24,}",
    "SENDGRID_KEY": r"SG\.[A-Za-z0-9_-]{16,32}\.[A-Za-z0-9_-]{32,64}",
    "TWILIO_KEY": r"SK[0-9a-f]{32}",
    "GCP_API_KEY": r"AIza[A-Za-z0-9_-]{35}",
    "GCP_OAUTH_SECRET": r"GOCSPX-[A-Za-z0-9_-]{28}|ya29\.[A-Za-z0-9_-]{30,}",
    "NPM_TOKEN": r"npm_[A-Za-z0-9]{30,60}",
    "PYPI_TOKEN": r"pypi-[A-Za-z0-9_-]{50,}",
    "HUGGINGFACE_TOKEN": r"hf_[A-Za-z0-9]{30,60}",
    "DIGITALOCEAN_TOKEN": r"do[opr]_v1_[0-9a-f]{64}",
    "VAULT_TOKEN": r"hv[sbr]\.[A-Za-z0-9_-]{20,}",
    "TELEGRAM_BOT_TOKEN": r"[0-9]{8,10}:AA[A-Za-z0-9_-]{30,40}",
    "JWT_TOKEN": r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    "OPENAI_KEY": r"sk-(?:proj-|svcacct-|ant-[a-z0-9]+-)?[A-Za-z0-9_-]{32,}",
    "SHOPIFY_TOKEN": r"shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}",
    "SQUARE_ACCESS_TOKEN": r"sq0(?:atp|csp)-[A-Za-z0-9_-]{22,43}",
    "GRAFANA_API_KEY": r"glsa_[A-Za-z0-9]{32}_[0-9a-f]{8}",
    "DOCKER_HUB_TOKEN": r"dckr_pat_[A-Za-z0-9_-]{27,}",
    "MAILGUN_KEY": r"key-[0-9a-f]{32}",
    "LINEAR_API_KEY": r"lin_api_[A-Za-z0-9]{40}",
    "RUBYGEMS_KEY": r"rubygems_[0-9a-f]{48}",
    "PREFIXED_TOKEN": r"[a-z]{2,5}_(?:live|prod)_[A-Za-z0-9]{20,250}",
}
_TOKEN = re.compile(r"(?<![A-Za-z0-9_+/.-])(?:" + "|".join(f"(?P<{k}>{v})" for k, v in TOKENS.items()) + r")(?![A-Za-z0-9_])")
_SECRET_WORD = r"pass(?:word|wd|phrase|code)?|pwd|pw|secret|token|api[_-]?key|auth[_-]?key|access[_-]?key(?:[_-]?id)?|secret[_-]?key|private[_-]?key|signing[_-]?key|encryption[_-]?key|account[_-]?key|license[_-]?key|shared[_-]?key|master[_-]?key|ssh[_-]?key|credentials?|webhook|passwort|kennwort|contrase(?:ñ|n)a|clave|mot[_ -]de[_ -]passe|auth"
# An identifier is tried once, from its beginning.
_NAME = rf"(?<![A-Za-z0-9_.$])(?P<name>(?:[A-Za-z0-9_.$-]*?(?:[_.$-]|[a-z0-9](?=[A-Z])))?(?:(?i:{_SECRET_WORD}))(?:[_-]?(?i:key|id|value|token|secret|[a-z]{{1,12}}[0-9]*|[0-9]+)){{0,2}})"
_VALUE = r"(?:\(\s*)?(?:[bru]?\"(?P<d>(?:[^\"\\\n]|\\.)*)\"|[bru]?'(?P<s>(?:[^'\\\n]|\\.)*)'|`(?P<t>[^`\n]*)`|(?P<b>[^\s\"'`,;<>(){}\[\]]+[^\s\"'`,;<>{}\[\]]*))"
_ASSIGN = re.compile(rf"(?<![A-Za-z0-9])--?{_NAME}[ =]{_VALUE}|{_NAME.replace('?P<name>', '?P<name2>')}[\"'`]?\]?\s*(?::=|=>|\|\||==?|:)[ \t]*{re.sub(r'[?]P<([dstb])>', r'?P<\1 2>', _VALUE).replace(' 2>', '2>')}")
_CALL = re.compile(rf"(?:set|put|setdefault|setProperty|add|define|setenv|getenv|get)\(\s*[\"']{_NAME}[\"']\s*,\s*(?:[bru]?\"(?P<d>[^\"\n]*)\"|[bru]?'(?P<s>[^'\n]*)')")
_FALLBACK = re.compile(rf"{_NAME}[\"'\])]*\s*(?:\|\||\?\?|\bor\b|:-)\s*(?:\"(?P<d>[^\"\n]*)\"|'(?P<s>[^'\n]*)'|(?P<b>[^\s\"'}}]+)\}})")
_BLOCK = re.compile(rf"\b(?:variable|output|secret|resource)\s+\"{_NAME}\"\s*\{{[^}}\n]*?\b(?:default|value)\s*=\s*\"(?P<d>[^\"\n]*)\"")
_XML = re.compile(rf"<{_NAME}(?:\s[^<>\n]*)?>(?P<d>[^<>\n]+)</")
_NAMED = re.compile(rf"^[ \t]*-?[ \t]*\"?(?:name|key)\"?[ \t]*:[ \t]*[\"']?{_NAME}[\"']?[ \t]*,?\r?\n[ \t]*\"?value\"?[ \t]*:[ \t]*(?:\"(?P<d>[^\"\n]*)\"|'(?P<s>[^'\n]*)'|(?P<b>[^\s\"',]+))", re.M)
_TO_FILE = re.compile(rf"\becho\s+(?:-n\s+)?[\"']?(?P<d>[^\s\"']+)[\"']?\s*>{{1,2}}\s*[\w./~-]*?\.?{_NAME}\b")
_URL = re.compile(r"\b(?P<scheme>[a-z][a-z0-9+.-]{1,30})://(?P<user>[^\s:/@\"'<>]*):(?P<d>[^\s@\"'<>]+)@(?=[\w.\[-])", re.I)
_HEADER = re.compile(r"\b(?:proxy-)?authorization[\"']?\s*[:=,]?\s*[\"']?\s*(?P<kind>basic|bearer|token|digest|apikey)\s+(?P<d>[^\s\"',;]+)", re.I)
_X_HEADER = re.compile(r"\bx-(?:api-key|auth-token|access-token|vault-token)[\"']?\s*[:=]\s*[\"']?(?P<d>[^\s\"',;]+)", re.I)
_COMMAND = re.compile(r"\b(?i:identified\s+by|with\s+password)\s+[\"'](?P<i>[^\"'\n]+)[\"']|\bsshpass\s+-p\s*[\"']?(?P<a>[^\s\"']+)|\b(?:mysql|mysqldump|mysqladmin|mariadb)\b[^\n|;]*?\s-p(?P<b>[^\s\"']+)|\bcurl\b[^\n|;]*?\s(?:-u|--user)[ =][\"']?[^\s:\"']+:(?P<c>[^\s\"']+)|\blogin\s+\S+\s+password\s+(?P<e>\S+)|\b(?:redis-cli)\b[^\n|;]*?\s-a\s*(?P<f>\S+)")
_PROSE = re.compile(r"(?i:\b(?:pass(?:word|phrase|code|wort)|pwd|kennwort|contrase(?:ñ|n)a|clave|mot de passe|token|api key|access key|secret(?: key)?|schlüssel|(?:wifi|wi-fi|wlan) (?:key|password|passwort)|clé(?: d'accès)?)\b)(?:[ \t]+(?i:is|es|est|ist|lautet|now|new|nueva|nuevo|neue|again|the|el|la|le|for|of|temporary|temporal|here|jetzt|ahora|maintenant|actual|wifi|to|until)\b){0,4}[ \t]*[:=]?[ \t]*[\"'`]?(?P<d>[^\s\"'`]{6,})")
#: Each kind of named value, and what a line must hold for it.
_NAMED_VALUES = ((_ASSIGN, ("=", ":", "||", "--")), (_CALL, ("(",)), (_FALLBACK, ("||", "??", " or ", ":-")), (_BLOCK, ("{",)), (_XML, ("</",)), (_TO_FILE, ("echo",)))
_PEM_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_BLANK = re.compile(r"\n[ \t]*\r?\n")
#: A header of a key block, up to its line's end, real or escaped; a line of its body, in any quotes, comment or concatenation.
_KEY_HEADER = re.compile(r"(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID)[ \t]*:(?:(?!\\[nr])[^\n])*")
_KEY_LINE = re.compile(r"[\s\"'`>#*/|+-]*=?(?:[A-Za-z0-9+/=]|\\[nr])+[\s\"'`,;+\\)]*")
_PUTTY = re.compile(r"PuTTY-User-Key-File-[23]:[^\n]*\n(?P<d>(?:(?!PuTTY-User-Key-File-)[^\n]*\n){2,}?Private-MAC: [0-9a-f]+)")
_CONNECTION = re.compile(r"(?:^|[;\"'\s])(?P<name>(?i:password|pwd|accountkey|sharedaccesskey|sharedaccesssignature))\s*=\s*(?P<d>[^;\"'\s]+)(?=;|[\"']|\s|$)")
_KUBERNETES = re.compile(r"^(?P<in>[ \t]*)kind:[ \t]*[\"']?Secret[\"']?[ \t]*\r?$", re.M)
_ENTRY = re.compile(r"^(?P<in>[ \t]+)[\"']?(?P<name>[\w.-]+)[\"']?[ \t]*:[ \t]*[\"']?(?P<d>[A-Za-z0-9+/_-]{4,}={0,2})[\"']?[ \t]*\r?$")

# The shortest literals are those of a value of six characters with its name.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{11,}={0,2}(?![A-Za-z0-9+/=])")
_BASE64_LINES = re.compile(r"(?:^[ \t]*[A-Za-z0-9+/]{40,76}[ \t]*\r?\n)+[ \t]*[A-Za-z0-9+/]{4,76}={0,2}[ \t]*\r?$", re.M)
_DATA_BEFORE, _HASH_BEFORE = re.compile(r"data:[\w.+-]+/[\w.+-]+;base64,$"), re.compile(r"sha(?:256|384|512)[-:]$")
_HEX = re.compile(r"(?<![0-9A-Za-z+/_-])(?:0x)?((?:[0-9a-fA-F]{2}){8,})(?![0-9A-Za-z+/_-])")
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}[^\s\"'<>`]*?%[0-9A-Fa-f]{2}(?:[^\s\"'<>`%]*%[0-9A-Fa-f]{2})*")
#: "%25" is a percent sign in each layer but the last.
_NESTED_PERCENT = re.compile(r"%(?:25)+(?=[0-9A-Fa-f]{2})")
_AROUND = " \t\r\n\"'<>`"
_IN_URL = re.compile(r"[^?&;=#/,]+")
_ESCAPED = re.compile(r"(?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]{1,6}\}|\\[0-7]{3}){6,}")
_ENTITIES = re.compile(r"(?:&#(?:x[0-9a-fA-F]{2,5}|[0-9]{2,6});){6,}")

#: What a value looks like that is no credential: a reference, a placeholder, a mask, a call.
_REFERENCE = re.compile(
    r"^(?:\$|%[A-Za-z_(]|\{\{|#\{|@|<|\[|!|&|vault:|ssm:|secretsmanager:|arn:|env[:.(]|file:|keyring:|op://|ref\+|sops:|azurekeyvault|https?:|(?:/[a-z0-9._-]+){2,}/?$|\./|~/|\.\.)"
    r"|^(?:os\.|process\.|System\.|ENV\b|env\.|config[.\[(]|settings\.|secrets?\.|self\.|this\.|request\.|args\.|opts?\.|options\.|params\.|ctx\.|data\.|var\.|local\.|module\.|cfg\.|getenv|getpass|input|prompt|read_|load_|get_|fetch_|new |async|await|lambda|function|\w+\(|\w+\[)"
    r"|\$\{|\{\{|\bvault:|process\.env|os\.environ|getpass\(|\.Values\.",
)
_PLACEHOLDER = re.compile(
    r"^(?:none|null|nil|true|false|undefined|empty|required|optional|string|str|int|bytes|text|bearer|basic|todo|tbd|n/?a|unset|default|missing|secret|password|passwd|token|key|pass|user|admin|root|test|value)$"
    r"|chang(?:e|e_|e-|ed)[_-]?(?:me|it|this)|your[_-]|[_-]here\b|placeholder|example|dummy|sample|fake|redacted|hidden|masked|censored|removed|not[_-]?(?:a[_-])?(?:real|set)|replace[_-]?(?:me|this|with)?|insert[_-]|to[_-]?be|put[_-]|my[_-]?(?:secret|password|token|key)|fill[_-]?in|s3cr3t|p@ssw0rd|hunter2|^foo|^bar$|lorem|xxxx|\*\*\*|\.\.\.|…|•••|----|____|####|^<.*>$|1234567890|abcdef",
    re.I,
)
_UUID = re.compile(r"^\{?[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\}?$")
#: Words of a name that make it something about a credential.
_NO_SECRET_WORDS = frozenset(
    "url uri endpoint path file filename dir length len size min max count expiry expires expire expiration ttl timeout age type name names policy regex pattern format field label hint prompt header scheme method enabled required valid hash algorithm algo alg public pub version rotation days env var ref store manager provider column table class prefix suffix index issuer audience limit budget tokens".split()
)
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | dict.fromkeys([0xA0, 0x2007, 0x202F, 0x3000], 0x20) | dict.fromkeys([0x2010, 0x2011], 0x2D)
_CHANGED = re.compile("[" + re.escape("".join(map(chr, _WIDE))) + "]")
#: Substrings of the lower-cased text one of which every finding needs, unless it has a long run or an escape.
_SIGNS = ("pass", "pwd", "pw", "secret", "token", "key", "auth", "cred", "hook", "kennwort", "contrase", "clave", "schl", "clé", "cle", "://", "mysql", "login", "curl", "redis", "identified", "akia", "asia", "&#", "\\x", "\\u", "%")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{11}")
_HINTS = ("AKIA", "ASIA", "ABIA", "ACCA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat", "glpat-", "gldt-", "glptt-", "glrt-", "glsoat-", "glcbt-", "xox", "xapp", "_live_", "_test_", "_prod_", "whsec", "SG.", "SK", "AIza", "GOCSPX", "ya29", "npm_", "pypi-", "hf_", "_v1_", "hvs.", "hvb.", "hvr.", ":AA", "eyJ", "sk-", "shp", "sq0", "glsa", "dckr", "key-", "lin_api", "rubygems")
_TOOLS = ("sshpass", "mysql", "mariadb", "curl", "login", "redis-cli", "identified", "with password")
_LINE_SIGNS = ("pass", "pwd", "secret", "token", "key", "auth", "cred", "hook", "kennwort", "contrase", "clave", "schl", "cle", "clé", "pw")


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def usable(value: str, quoted: bool = True) -> bool:
    """Whether a named value can be a credential, and is no placeholder, mask, reference or identifier."""
    v = value.strip()
    if len(v) < 6 or len(set(v)) < 4 or _REFERENCE.search(v) or _PLACEHOLDER.search(v) or _UUID.match(v) or " " in v and len(v.split()) > 3:
        return False
    digit, symbol = any(c.isdigit() for c in v), any(not c.isalnum() for c in v)
    if not any(c.isalpha() for c in v):
        return False
    if not digit:  # a word or an identifier, unless long and random
        turns = len(re.findall(r"[a-z](?=[A-Z])|[A-Z](?=[A-Z]?[a-z])", v))
        return len(v) >= 16 and entropy(v) >= 3.4 and turns >= len(v) / 4 or (quoted and symbol and len(v) >= 8 and v.lower() != v and not re.fullmatch(r"[\w.\- ]+", v))
    return quoted or not re.fullmatch(r"[a-z_]+[.\-][a-z_.\-]*\d{1,4}|[a-z]+_?\d{1,2}|\d+[a-z]{1,3}", v)


def _secret_name(name: str) -> bool:
    last = re.split(r"[.$]", name)[-1]
    return not any(w.lower() in _NO_SECRET_WORDS for w in _NAME_WORDS.findall(last))


def _kind(name: str) -> str:
    n = name.lower()
    if "bearer" in n:
        return "BEARER_TOKEN"
    return "GENERIC_SECRET"


class Clean:
    """A text without invisible characters and with plain forms of wide ones; places map back to the original."""

    def __init__(self, text: str) -> None:
        self.places = None
        if not text.isascii():
            if _INVISIBLE.search(text):
                self.places, at = [], 0
                for m in _INVISIBLE.finditer(text):
                    self.places += range(at, m.start())
                    at = m.end()
                self.places += range(at, len(text) + 1)
                text = _INVISIBLE.sub("", text)
            if _CHANGED.search(text):
                text = text.translate(_WIDE)
        self.text = text

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.places is None or end <= start:
            return start, end
        return self.places[start], self.places[end - 1] + 1


def _printable(raw: bytes) -> str | None:
    try:
        s = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return s if s and sum(c.isprintable() or c in "\r\n\t" for c in s) == len(s) else None


def _base64(s: str) -> bytes | None:
    s = "".join(s.split()).rstrip("=")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s.replace("-", "+").replace("_", "/") + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _groups(m: re.Match) -> tuple[int, int, bool] | None:
    """(start, end, quoted) of the value of a match."""
    for g, v in m.groupdict().items():
        if v is not None and g[0] in "dstbacef" and g in _VALUES:
            return m.start(g), m.end(g), g[0] != "b"
    return None


_VALUES = {"d", "s", "t", "b", "d2", "s2", "t2", "b2"}


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the credentials of a plain text; spans of one literal may overlap."""
    out: list[tuple[int, int, str]] = []
    low = text.lower()
    for m in _PEM_BEGIN.finditer(text) if "PRIVATE KEY" in text else ():
        if (end := _key_end(text, m.end())) is None:
            continue
        inside = _KEY_HEADER.sub("", _PEM_END.sub("", text[m.end() : end]))
        body = re.sub(r"\\[nr]|[\s\"'+,\\]", "", inside)
        if len(re.findall(r"[A-Za-z0-9+/=]", body)) >= 40 and len(set(body)) > 10 and not _PLACEHOLDER.search(inside[:60].replace("-", "")):
            out.append((m.start(), end, "PRIVATE_KEY"))
    out += [(m.start(), m.end(), "PRIVATE_KEY") for m in _PUTTY.finditer(text)] if "PuTTY" in text else []
    if any(h in text for h in _HINTS):
        for m in _TOKEN.finditer(text):
            if not _PLACEHOLDER.search(m.group()) and entropy(m.group()) > 2.5:
                out.append((m.start(), m.end(), m.lastgroup))
    lines: list[tuple[int, int]] = []
    if len(low) == len(text):
        found: set[int] = set()
        for w in _LINE_SIGNS:  # the text is read once for each sign, and a line that has it is left behind at once
            at = low.find(w)
            while at >= 0:
                found.add(low.rfind("\n", 0, at) + 1)
                at = low.find("\n", at)
                at = low.find(w, at) if at >= 0 else -1
        lines = [(x, len(text) if (end := text.find("\n", x)) < 0 else end) for x in sorted(found)]
    else:  # a letter whose lower case is longer: places by the text itself
        at = 0
        for line in text.split("\n"):
            if any(w in line.lower() for w in _LINE_SIGNS):
                lines.append((at, at + len(line)))
            at += len(line) + 1
    for start, end in lines:
        out += _line(text, start, end)
    if "value" in text and lines:
        for m in _NAMED.finditer(text):
            _named(text, m, out)
    if "://" in text:
        for m in _URL.finditer(text):
            v = unquote(m["d"])
            if len(v) >= 4 and len(set(v)) >= 3 and not _REFERENCE.search(v) and not _PLACEHOLDER.search(v):
                out.append((m.start("d"), m.end("d"), "DATABASE_CONNECTION_STRING"))
    for m in _HEADER.finditer(text) if "authorization" in low else ():
        v, kind = m["d"], m["kind"].lower()
        if kind == "basic":
            plain = _printable(_base64(v) or b"")
            if plain and ":" in plain and len(plain.partition(":")[2]) >= 4 and not _REFERENCE.search(plain.partition(":")[2]) and not _PLACEHOLDER.search(plain.partition(":")[2]):
                out.append((m.start("d"), m.end("d"), "BASIC_AUTH"))
        elif len(v) >= 12 and usable(v):
            out.append((m.start("d"), m.end("d"), "BEARER_TOKEN"))
    for m in _COMMAND.finditer(text) if any(w in low for w in _TOOLS) else ():
        g = m.lastgroup
        if usable(m[g]):
            out.append((m.start(g), m.end(g), "GENERIC_SECRET"))
    for m in _KUBERNETES.finditer(text) if "Secret" in text else ():
        out += _secret_manifest(text, m)
    out += _decoded(text)
    return out


def _key_end(text: str, at: int) -> int | None:
    """Where the key block ends whose BEGIN mark ends at ``at``, or None.

    It ends at its END mark, with blank lines inside if all other lines are headers or body; else at the first blank line
    that has body before it or none behind it, else with the text. Another BEGIN ends no block.
    """
    stop = text.find("-----BEGIN", at)
    limit = len(text) if stop < 0 else stop
    mark = _PEM_END.search(text, at, limit)
    whole = mark.start() if mark else limit
    blanks = list(_BLANK.finditer(text, at, whole))
    if not blanks:
        return mark.end() if mark else limit if stop < 0 else None
    rest = _KEY_HEADER.sub("", text[at:whole])
    if mark and all(_KEY_LINE.fullmatch(x) for x in rest.split("\n") if x.strip(" \t\r\"'`>#*/|+-")):
        return mark.end()
    for b in blanks:
        behind = text[b.end() : whole].lstrip().split("\n", 1)[0]
        if len(re.sub(r"\s", "", _KEY_HEADER.sub("", text[at : b.start()]))) >= 16 or not (_KEY_LINE.fullmatch(behind) and re.search(r"[A-Za-z0-9+/]{40}", behind)):
            return b.end()
    return mark.end() if mark else limit if stop < 0 else None


def _named(text: str, m: re.Match, out: list[tuple[int, int, str]]) -> None:
    name, value = m.groupdict().get("name") or m.groupdict().get("name2"), _groups(m)
    if value and _secret_name(name) and usable(text[value[0] : value[1]], value[2]):
        out.append((value[0], value[1], _kind(name)))


def _line(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """Findings on a line that has a telling word."""
    out: list[tuple[int, int, str]] = []
    line = text[start:end]
    for pattern, signs in _NAMED_VALUES:
        if any(x in line for x in signs):
            for m in pattern.finditer(text, start, end):
                _named(text, m, out)
    for m in _CONNECTION.finditer(text, start, end) if "=" in line else ():
        if usable(m["d"]):
            out.append((m.start("d"), m.end("d"), "CONNECTION_STRING"))
    for m in _X_HEADER.finditer(text, start, end) if "x-" in line or "X-" in line else ():
        if usable(m["d"]):
            out.append((m.start("d"), m.end("d"), "BEARER_TOKEN"))
    for m in _PROSE.finditer(text, start, end):
        v = m["d"].rstrip(".,;:!?)")
        if usable(v, False) and any(c.isdigit() for c in v) and any(c.isupper() or not c.isalnum() for c in v) and not re.match(r"[\d.,:/%-]+$", v) and "://" not in v and "@" not in v[1:]:
            out.append((m.start("d"), m.start("d") + len(v), "GENERIC_SECRET"))
    return out


def _secret_manifest(text: str, m: re.Match) -> list[tuple[int, int, str]]:
    """The values under data and stringData of a Secret, which are encoded."""
    out, at, inside = [], m.end() + 1, False
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if not inside:
            inside = re.match(r"[ \t]*(?:data|stringData):[ \t]*\r?$", line) is not None
            if not inside and not re.match(r"[ \t]*(?:apiVersion|metadata|type|name|namespace|labels|immutable)\b", line):
                break
        else:
            e = _ENTRY.match(line)
            if not e or len(e["in"].expandtabs()) <= len(m["in"].expandtabs()):
                break
            plain = _printable(_base64(e["d"]) or b"")
            if plain and (usable(plain) or len(plain) >= 6 and any(map(str.isdigit, plain)) and not _PLACEHOLDER.search(plain) and not _REFERENCE.search(plain) and not _UUID.match(plain)):
                out.append((at + e.start("d"), at + e.end("d"), "KUBERNETES_SERVICE_TOKEN"))
        at = end + 1
    return out


def _decoded(text: str) -> list[tuple[int, int, str]]:
    """Findings inside encoded literals, at the place of the whole literal."""
    out = []

    def rescan(start: int, end: int, plain: str | None) -> None:
        if plain and len(plain) >= 8 and _may_hold(plain):
            out.extend((start, end, kind) for _, _, kind in scan(plain)[:1])

    runs = _RUN.search(text) is not None
    for m in _BASE64_LINES.finditer(text) if runs else ():
        if "\n" in m.group() and "-----" not in text[max(0, m.start() - 40) : m.start()]:
            raw = _base64(m.group())
            if raw and (kind := keyfiles.private_key_kind(raw)):
                out.append((m.start() + len(m.group()) - len(m.group().lstrip()), m.end(), "PRIVATE_KEY" if kind else ""))
            elif raw:
                rescan(m.start(), m.end(), _printable(raw))
    for m in _BASE64.finditer(text) if runs else ():
        before = text[max(0, m.start() - 40) : m.start()]
        if before[-1:] == "," and _DATA_BEFORE.search(before) or before[-1:] in ("-", ":") and _HASH_BEFORE.search(before):
            continue
        raw = _base64(m.group())
        if raw is None:
            continue
        if keyfiles.private_key_kind(raw):
            out.append((m.start(), m.end(), "PRIVATE_KEY"))
        else:
            rescan(m.start(), m.end(), _printable(raw))
    for m in _HEX.finditer(text) if runs else ():
        raw = bytes.fromhex(m.group(1))
        if keyfiles.private_key_kind(raw):
            out.append((m.start(), m.end(), "PRIVATE_KEY"))
        else:
            rescan(m.start(), m.end(), _printable(raw))
    if "%" in text:
        for m in _PERCENT.finditer(text):
            start, end = m.start(), m.end()
            while start and text[start - 1] not in _AROUND:
                start -= 1
            while end < len(text) and text[end] not in _AROUND:
                end += 1
            # Of an address each part is a literal of its own; the whole is scanned as it stands.
            for a, b in [(start, end)] if "://" not in text[start:end] else [x.span() for x in _IN_URL.finditer(text, start, end)]:
                plain, coded = text[a:b], None
                while "%" in plain and plain != coded:
                    coded, plain = plain, unquote(_NESTED_PERCENT.sub("%", plain))
                    if plain != coded:
                        rescan(a, b, plain)
    if "\\" in text:
        for m in _ESCAPED.finditer(text):
            plain = re.sub(r"\\x([0-9a-fA-F]{2})|\\u([0-9a-fA-F]{4})|\\u\{([0-9a-fA-F]{1,6})\}|\\([0-7]{3})", lambda e: chr(min(0x10FFFF, int(e[1] or e[2] or e[3], 16) if not e[4] else int(e[4], 8))), m.group())
            rescan(m.start(), m.end(), plain)
    if "&#" in text:
        for m in _ENTITIES.finditer(text):
            rescan(m.start(), m.end(), re.sub(r"&#(?:x([0-9a-fA-F]+)|([0-9]+));", lambda e: chr(min(0x10FFFF, int(e[1], 16) if e[1] else int(e[2]))), m.group()))
    return out


def _may_hold(text: str) -> bool:
    low = text.lower()
    return any(w in low for w in _SIGNS) or _RUN.search(text) is not None


def findings(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, type) in the original text, ordered and without overlaps; of overlapping ones the earliest, then the longest stays."""
    if not text or not _may_hold(text):
        return []
    clean = Clean(text)
    out: list[tuple[int, int, str]] = []
    for start, end, kind in sorted(set(scan(clean.text)), key=lambda f: (f[0], -f[1], f[2] == "GENERIC_SECRET", f[2])):
        s, e = clean.span(start, end)
        if out and s < out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e, out[-1][2])
            if out[-1][2] == "GENERIC_SECRET" and kind != "GENERIC_SECRET":
                out[-1] = (*out[-1][:2], kind)
            continue
        out.append((s, e, kind))
    return out


def redacted(text: str, found: list[tuple[int, int, str]]) -> str:
    """Each value replaced by a word that stands in any quotes or none; a key block keeps its marks and its lines' number."""
    parts, at = [], 0
    for s, e, kind in found:
        parts += [text[at:s], f"REDACTED_{kind}" + "\n" * text.count("\n", s, e)]
        at = e
    return "".join([*parts, text[at:]])


def find_credentials(df: DataFrame, key: str = "scan_id", text: str = "text", redact: bool = False) -> DataFrame:
    """(key, line_no, start_pos, end_pos, entity_type) of each credential, or (key, text, n_credentials) with ``redact``.

    Null and empty texts have no finding, and are redacted to themselves. Places count code points of the text as it is,
    lines count from 1 and end at a newline. Repeated rows give their findings again.
    """
    ship(df.sparkSession)
    x = spread(df.select(df[key].alias("k"), df[text].alias("t")))
    kind = x.schema["k"].dataType.simpleString()

    def search(batches):
        for p in batches:
            at, rows = [], []
            for i, t in enumerate(p["t"]):
                line, upto = 1, 0
                for s, e, k in findings(t):
                    line, upto = line + t.count("\n", upto, s), s
                    at.append(i)
                    rows.append((line, s, e, k))
            out = pd.DataFrame(rows, columns=["line_no", "start_pos", "end_pos", "entity_type"])
            out.insert(0, "k", p["k"].to_numpy()[at])
            yield out

    def clean(batches):
        for p in batches:
            found = [findings(t) for t in p["t"]]
            yield pd.DataFrame({"k": p["k"], "t": [redacted(t, f) if f else t for t, f in zip(p["t"], found)], "n": [len(f) for f in found]})

    if redact:
        return x.mapInPandas(clean, f"k {kind}, t string, n int").toDF(key, text, "n_credentials")
    return x.mapInPandas(search, f"k {kind}, line_no bigint, start_pos int, end_pos int, entity_type string").withColumnRenamed("k", key)
