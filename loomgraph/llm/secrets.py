"""Credentials in source code: find them and mask them without changing the rest of the file.

Every file is scanned once by a ``mapInArrow`` stage. Literals and unquoted values are read with the name they
are given; a value is a credential by its own format (key prefixes, signed tokens, private-key blocks, user and
password in an address or header) or by a name that stands for a secret and a value that isn't a placeholder,
reference or ordinary word. Encoded layers (base64, also over several lines, hex, percent, escapes; UTF-8 or UTF-16)
are decoded and scanned again, however deep, as every layer is shorter than its encoding; binary results are parsed by the grammar of key containers (DER structures, the OpenSSH key
format, PKCS 12). A finding inside an encoded literal masks the whole enclosing literal.

Defined results
 * Masking replaces each character of the value by '*', so lengths, lines and quotes stay; a private-key block
   keeps its BEGIN and END lines and the line breaks or escapes between.
 * Null or empty content: no findings, and the content comes back as it was. Repeats of a file count once in the
   findings. Line numbers count from 1 and split at '\\n'; a carriage return belongs to its line.
 * Whole texts are scanned, whatever their length, in time linear in it: names are at most NAME characters long, a
   value's names are sought as far back as the third literal before it, and positions are looked up by bisection.
 * A private key without an END line is masked as far as lines of base64 or armour go.
"""

from __future__ import annotations

import base64
import binascii
import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread_scan

#: The longest name of a secret, in characters.
NAME = 120

#: Endings of names that stand for a secret, letters only.
SECRET_ENDINGS = (
    "password", "passwd", "passphrase", "passcode", "pass", "pwd", "pw", "secret", "token", "apikey", "accesskey", "secretkey", "privatekey",
    "signingkey", "encryptionkey", "masterkey", "authkey", "accountkey", "sharedkey", "servicekey", "credential", "credentials", "creds", "bearer", "authorization",
    "adminpw", "rootpw", "userpw", "dbpw", "smtppw", "kennwort", "passwort", "motdepasse", "contrasena", "clave", "senha", "wachtwoord", "parola",
)
#: Last words of names that only talk about a secret, or hold digests, ids and public values.
PLAIN_ENDINGS = (
    "label", "type", "name", "field", "hint", "prefix", "suffix", "scheme", "header", "id", "count", "length", "limit", "policy", "path", "file", "ttl",
    "expiry", "index", "url", "uri", "etag", "digest", "integrity", "checksum", "hash", "commit", "verifier", "fingerprint", "icon", "logo", "format", "rule",
)
#: (kind, substrings of which every match holds one, pattern).
FORMATS = [
    (kind, hints.split(), re.compile(p))
    for kind, hints, p in (
        ("access key", "AKIA ASIA AGPA AROA", r"(?<![A-Za-z0-9])A(?:KIA|SIA|GPA|ROA)[0-9A-Z]{16}(?![0-9A-Za-z])"),
        ("platform token", "ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat-", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{30,}|(?<![A-Za-z0-9])github_pat_[A-Za-z0-9_]{30,}|(?<![A-Za-z0-9])glpat-[\w-]{18,}"),
        ("map key", "AIza", r"(?<![A-Za-z0-9])AIza[\w-]{30,}"),
        ("chat token", "xox", r"(?<![A-Za-z0-9])xox[abeoprs]-[A-Za-z0-9-]{10,}"),
        ("payment key", "k_live_ k_test_", r"(?<![A-Za-z0-9])[spr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
        ("registry token", "npm_ pypi- dop_v1_", r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{30,}|(?<![A-Za-z0-9])pypi-[\w-]{40,}|(?<![A-Za-z0-9])dop_v1_[0-9a-f]{40,}"),
        ("mail key", "SG.", r"(?<![A-Za-z0-9])SG\.[\w-]{16,}\.[\w-]{16,}"),
        ("vault token", "hvs. hvb. hvr.", r"(?<![A-Za-z0-9])hv[sbr]\.[\w-]{20,}"),
        ("model key", "sk- ya29.", r"(?<![A-Za-z0-9])sk-(?:[a-z]+-)?[A-Za-z0-9_-]{32,}|(?<![A-Za-z0-9])ya29\.[\w-]{20,}"),
        ("signed token", "eyJ", r"(?<![A-Za-z0-9])eyJ[\w-]{8,}\.eyJ[\w-]{4,}\.[\w-]{10,}"),
    )
]
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_ARMOUR_LINE = re.compile(r"((?:(?!\\[nr])[^\r\n])*)(?:\r?\n|\r|\\[nr]|\Z)")
_BASE64_LINE = re.compile(r"[A-Za-z0-9+/=]+")
_ARMOUR_HEADER = re.compile(r"(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):", re.I)
_AROUND = " \t\"'`,;.#*>|()\\+-"
_PUBLIC = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*(?:PUBLIC KEY|CERTIFICATE(?: REQUEST)?)-----.*?-----END (?:[A-Z0-9]+ )*(?:PUBLIC KEY|CERTIFICATE(?: REQUEST)?)-----", re.S)
_IMAGE = re.compile(r"data:(?:image|audio|video|font)/[\w+.-]+;base64,[A-Za-z0-9+/=]*")
_ADDRESS = re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://([^\s:/?#@\"'`<>]*):([^\s/@\"'`<>]+)@[A-Za-z0-9\[$]")
_USERPASS = re.compile(r"(?<!\S)(?:-u|--user|--proxy-user)[ =]+['\"]?([\w.+-]+):([^\s'\"]+)")
_SCHEME = re.compile(r"\b(basic|bearer|token)\s+([A-Za-z0-9+/=_.~-]{6,})", re.I)
_HEADER = re.compile(r"authori[sz]ation|header|-H\b", re.I)
_LITERAL = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'|`((?:[^`\\]|\\.)*)`')
_QUOTED = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'')
_INSIDE = re.compile(r"\w'\w|`")
_DIRECT = re.compile(r"([A-Za-z_$][\w$-]{0,%d})[\"'`]?\]?\s*(?:[:=!]?==?|:|=>)\s*[rRbBfFuU@$]{0,2}(?:\"([^\"\\\n]+)\"|'([^'\\\n]+)')" % NAME)
_HTML = re.compile(r"([A-Za-z_$][\w$-]{0,%d})(?:&(?:quot|apos|#34|#39);)?\s*(?::?=|:|=>)\s*&(quot|apos|#34|#39);([^\n]*?)&\2;" % NAME)
_JOIN = re.compile(r"\s*(?:\+|\.\.?|\\)\s*|[ \t]*\r?\n[ \t]*")
_OPENED = re.compile(r"\(\s*$")
_NAME_BEFORE = re.compile(r"([A-Za-z_$][\w$-]{0,120})\s*(?:\??:\s*[\w<>\[\]. |]+?\s*(?==))?(?:[:=!]?==?|[:]|=>|<-|\bwas\b|\bis\b|\bto\b)\s*[rRbBfFuU@$]{0,2}$")
_KEY_BEFORE = re.compile(r"([\"'`])([\w.$ -]{1,60})\1\s*[\])]?\s*(?:[:=!]?==?|:|,|=>|\bto\b|\bwas\b|\bis\b)\s*[rRbBfFuU@]{0,2}$")
_CALL_BEFORE = re.compile(r"[.>:]([A-Za-z_]\w{0,120})\(\s*$")
_DEFAULT_BEFORE = re.compile(r"([A-Za-z_$][\w$-]{0,120})\s*(?::\s*[\w<>\[\] |]+)?\s*:?=[^=\"'`]*?(?:\|\||\?\?|\bor\b|\?:)\s*$")
_ENV_BEFORE = re.compile(r"env(?:iron)?[.\[(]+[\"']?(\w+)[\"'\])]*\s*(?:\|\||\?\?|\bor\b|\?:|,)\s*$", re.I)
_VALUE_BEFORE = re.compile(r"\b(?:name|key|id)\s*=\s*[\"']([\w.-]+)[\"']\s+(?:value|content)\s*=\s*$", re.I)
_ANNOTATION_BEFORE = re.compile(r"@\w+\(\s*(?:\w+\s*=\s*)?$")
_NAME_AFTER = re.compile(r"\s*\)\s*(?:(?:private|public|protected|final|static)\s+)*[\w<>\[\]]+\s+(\w+)")
_PLAIN = [
    re.compile(r"(?m)^[ \t]*(?:[-*][ \t]+)?(?:(?:#+|//+|--|;|/\*+|\*|<!--)[ \t]*)?(?:(?:export|set|old|declare|ENV|ARG|setx)[ \t]+)*([A-Za-z_][\w.-]*)[ \t]*(?:=|:|\bwas\b|\bis\b)[ \t]*([^\s\"'`][^\s]*)[ \t]*(?:(?:#|//|-->|\*/)[^\n]*)?\r?$"),
    re.compile(r"<([A-Za-z_][\w.-]*)(?:[ \t][^<>]*)?>\s*([^\s<>]+)\s*</\1>"),
    re.compile(r"(?m)^[ \t]*\|[ \t]*`?([A-Za-z_][\w.-]*)`?[ \t]*\|[ \t]*`?([^\s|`]+)`?[ \t]*(?=\|)"),
    re.compile(r"(?<!\S)--([A-Za-z][\w-]*)[= ]([^\s\"'`]+)"),
    re.compile(r"[?&]([A-Za-z_][\w.-]*)=([^&\s\"'`#<>)]+)"),
    re.compile(r"(?m)^[ \t]*(?:-[ \t]+)?([A-Za-z_][\w.-]*):[ \t]*[|>][-+]?[ \t]*\r?\n[ \t]+([^\s\"'`]+)[ \t]*\r?$"),
    re.compile(r"(?<![\w-])([A-Z][A-Z0-9_]{2,})=([^\s\"'`;]+)[ \t]+[./\w]"),
    re.compile(r"\b(?:login[ \t]+\S+[ \t]+)(password)[ \t]+(\S+)"),
]
#: Substrings of which every match of the pattern in _PLAIN holds one.
_PLAIN_HINTS = [("=", ":", " was ", " is ", "\twas", "\tis"), ("</",), ("|",), ("--",), ("?", "&"), ("|", ">"), ("=",), ("login",)]
_WRAP = re.compile(r"[ \t\"',+\\]*\r?\n[ \t\"',+]*([A-Za-z0-9+/]+={0,2})")
_ENCODED = re.compile(r"(?<![A-Za-z0-9+/=_%\\-])(?:[A-Za-z0-9+/_-]{16,}={0,2}|(?:%[0-9A-Fa-f]{2}|[\w.~-])*(?:%[0-9A-Fa-f]{2}(?:[\w.~-])*){4,}|(?:\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2}){6,})")
#: Parameters of an address that are keys of their own.
_SIGNATURE = re.compile(r"(?:x-\w+-)?(?:sig|signature|key|auth|sas|code|jwt|sessionid|session)", re.I)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_DUMMY = re.compile(
    r"^(?:change[-_ ]?(?:me|it|this)|replace[-_ ]?(?:me|this)?|to-?do|tbd|fixme|redacted|masked|hidden|removed|none|null|nil|undefined|true|false|yes|no|dummy|placeholder|example|sample|"
    r"password|passwd|pass|secret|token|user|key|test|default|empty|n/?a|unset|string|insert[-_ ].*|enter[-_ ].*|(?:your|my|the|some|any)[-_ ].*|put[-_ ].*|(?:[xX*.•#_-])\1*|x+|X+|\*+|\.+|•+|#+|-+)$"
    .replace(r"(?:[xX*.•#_-])\1*|", ""), re.I,
)
_REFERENCE = re.compile(
    r"^(?:\$[\w({]|\$\$|%[\w(]+[%)]|\{\{|\{%|<[^>]*>$|\[[^\]]*\]$|#\{|@[\w.]+[({]|env[:.(]|vault[:.(]|ssm:|arn:|op://|secret(?:s|sref)?[:.(]|ref[:+.]|os\.|process\.|system\.|std::|getenv|config\.|settings\.|self\.|this\.|file:|!\w|&\w|\*\w|ENC\[)", re.I,
)
_RUN = re.compile(r"([xX*.0#])\1{7,}")


def name_kind(name: str) -> str:
    """'secret', 'plain' or '' of a name in any spelling."""
    words = [w.lower() for w in _WORDS.findall(name) if not w.isdigit()]
    if not words:
        return ""
    joined = "".join(words)
    if words[-1] in PLAIN_ENDINGS:
        return "plain"
    if joined.endswith(SECRET_ENDINGS):
        ends_word = any(joined.endswith(e) and any("".join(words[i:]) == e for i in range(len(words))) for e in SECRET_ENDINGS)
        return "secret" if ends_word or joined.endswith(("password", "passwd", "secret", "token", "apikey", "pass", "pwd", "adminpw", "rootpw", "userpw", "dbpw", "smtppw", "motdepasse", "kennwort", "credential", "bearer", "signingkey", "encryptionkey", "privatekey")) and not joined.endswith(("bypass", "compass")) else ""
    return "plain" if joined.endswith(PLAIN_ENDINGS) and words[-1] not in ("pass",) and any("".join(words[i:]) in PLAIN_ENDINGS for i in range(len(words))) else ""


def is_dummy(value: str) -> bool:
    """Empty, masked, a placeholder or a reference to where the value is kept."""
    v = value.strip()
    return not v or bool(_DUMMY.match(v) or _REFERENCE.match(v) or _RUN.search(v)) or len(set(v)) < 3 or "${" in v or "{{" in v or "$(" in v


def _decoded_text(value: str) -> str | None:
    """Printable text behind base64, or None."""
    if len(value) < 8 or len(value) % 4 or not re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", value):
        return None
    try:
        text = base64.b64decode(value, validate=True).decode("ascii")
    except (ValueError, UnicodeDecodeError):
        return None
    return text if text.isprintable() else None


#: Short words without a vowel that are words all the same.
_NO_VOWELS = {"db", "js", "ts", "css", "html", "sql", "http", "https", "ssh", "tls", "ssl", "pwd", "jwt", "ldap", "xml", "csv", "vpn", "ftp", "gcp", "aws", "cfg", "tmp", "src", "svc", "prod", "dns", "tcp", "rpc", "grpc", "kms", "ssm", "md", "pg"}


def _is_random(part: str) -> bool:
    """Letters that are no word: cases mixed at random, or no vowel."""
    if len(part) >= 3 and not re.fullmatch(r"[a-z]+|[A-Z]+|[A-Z][a-z]+|[a-z]{2,}(?:[A-Z][a-z]{2,})+|(?:[A-Z][a-z]{2,})+", part):
        return True
    return len(part) >= 2 and part.islower() and not re.search(r"[aeiouy]", part) and part not in _NO_VOWELS


def is_secret_value(value: str) -> bool:
    """Whether a literal given to a secret's name can itself give access."""
    v = value.strip()
    if len(v) < 5 or len(v.split(None, 1)) > 1 or is_dummy(v):
        return False
    if (inner := _decoded_text(v)) is not None and is_dummy(inner):
        return False
    if re.fullmatch(r"[A-Za-z]+", v):  # one word or identifier, unless the cases are mixed at random
        return not re.fullmatch(r"[a-z]+|[A-Z]+|[A-Z][a-z]+|[a-z]{2,}(?:[A-Z][a-z]{2,})+|(?:[A-Z][a-z]{2,})+", v) and len(v) >= 8
    if re.fullmatch(r"[A-Za-z]+(?:[._/-][A-Za-z]+)+", v) and len(v) >= 8 and any(_is_random(part) for part in re.split(r"[._/-]", v)):
        return True
    if re.fullmatch(r"[A-Za-z]+(?:-[A-Za-z]+)+", v) and re.fullmatch(r"[a-z-]+|[A-Z-]+", v):
        return v.count("-") >= 3
    if re.fullmatch(r"[A-Za-z]+(?:[._/][A-Za-z]+)*[./]?|\.{0,2}/?[a-z]+(?:/[a-z]+)*/?", v) and not re.search(r"[a-z][A-Z]{2,}[a-z]|[A-Z][a-z][A-Z]", v):
        return False
    if v.isdigit():
        return len(v) >= 6
    if re.fullmatch(r"[\d.,:]+(?:ms|s|m|h|d|kb|mb)?", v, re.I):
        return False
    return not re.search(r"[\w)\]]\(.*\)?$", v) or not re.match(r"[A-Za-z_][\w.]*\(", v)


#: Words by which a sentence is told from a passphrase.
_SENTENCE = set("a an and are at be by can for from has in is it least must new no not of on or our over please set should that the their this to use will with you your".split())


def is_passphrase(value: str) -> bool:
    """Four words or more that make no sentence."""
    words = value.split()
    return len(words) >= 4 and all(re.fullmatch(r"[a-z]{3,12}", w) and w not in _SENTENCE for w in words)


def _der(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER elements in a range, or None when it isn't a whole sequence of them."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 0 < k <= 4 or at + k > end:
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def key_container(data: bytes) -> str | None:
    """The kind of private-key container the bytes are by their grammar, or None (public keys, certificates, others)."""
    if data.startswith(b"openssh-key-v1\0"):
        return "OpenSSH private key"
    outer = _der(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return None
    parts = _der(data, outer[0][1], outer[0][2])
    if not parts:
        return None
    tags = [p[0] for p in parts]
    first = data[parts[0][1] : parts[0][2]] if tags[0] == 2 else b""
    if tags[:3] == [2, 0x30, 4] and first in (b"\0", b"\1"):
        return "PKCS 8 private key"
    if len(tags) >= 9 and set(tags[:9]) == {2} and first in (b"\0", b"\1"):
        return "RSA private key"
    if len(tags) == 6 and set(tags) == {2} and first == b"\0":
        return "DSA private key"
    if tags[:2] == [2, 4] and first == b"\1":
        return "EC private key"
    if tags[:2] == [2, 0x30] and first == b"\3":
        return "PKCS 12 store"
    if tags == [0x30, 4]:
        return "encrypted PKCS 8 private key"
    return None


def _layers(token: str) -> Iterator[bytes]:
    """What the token may be the encoding of; percent signs encoded again are decoded to the end."""
    if "%" in token:
        while (inner := unquote(token)) != token:
            token = inner
        yield token.encode("utf-8", "ignore")
        return
    if "\\" in token:
        try:
            yield token.encode("latin-1", "ignore").decode("unicode_escape").encode("utf-8", "ignore")
        except UnicodeDecodeError:
            pass
        return
    if re.fullmatch(r"[0-9a-fA-F]+", token):
        if len(token) % 2 == 0:
            yield bytes.fromhex(token)
        return
    body = token.rstrip("=")
    if len(body) % 4 == 1:
        return
    try:
        yield base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        pass


def _text_of(data: bytes) -> str | None:
    """Printable text behind bytes of UTF-8 or, where every other byte is zero, UTF-16; or None."""
    tables = ["utf-8"]
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        tables = ["utf-16"]
    elif len(data) >= 8 and len(data) % 2 == 0 and b"\0" in data:
        tables = ["utf-16-le"] if not any(data[1::2]) else ["utf-16-be"] if not any(data[::2]) else []
    for table in tables:
        try:
            text = data.decode(table)
        except UnicodeDecodeError:
            continue
        if text and text.translate(_BREAKS).isprintable():
            return text
    return None


_BREAKS = dict.fromkeys(map(ord, "\r\n\t"))


def _armour_end(text: str, start: int) -> int:
    """Where a key block without an END line ends: after the last of the following lines, real or escaped, that are base64
    or armour, between quotes, comment signs and the like. A line of under 16 characters can only be the last."""
    end = start
    for m in _ARMOUR_LINE.finditer(text, start):
        line = m.group(1).strip(_AROUND)
        whole = _BASE64_LINE.fullmatch(line)
        if line and not whole and not _ARMOUR_HEADER.match(line):
            break
        if line:
            end = m.end(1)
        if m.end() == len(text) or whole and len(line) < 16 and m.start() > start:
            break
    return end


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _covers(merged: tuple[list[int], list[int]], at: int) -> bool:
    k = bisect_right(merged[0], at) - 1
    return k >= 0 and at < merged[1][k]


class _Scan:
    """One text: spans (start, end, kind) of credentials."""

    def __init__(self, text: str):
        self.text = text
        self.spans: list[tuple[int, int, str]] = []
        quiet = [m.span() for m in _PUBLIC.finditer(text)] if "-----BEGIN" in text else []
        self.quiet = _merged(quiet + ([m.span() for m in _IMAGE.finditer(text)] if "data:" in text else []))
        self.run()

    def add(self, start: int, end: int, kind: str) -> None:
        if end > start and not _covers(self.quiet, start):
            self.spans.append((start, end, kind))

    def run(self) -> None:
        text = self.text
        if "-----BEGIN" in text:
            self.keys()
        for kind, hints, pattern in FORMATS:
            if any(h in text for h in hints):
                for m in pattern.finditer(text):
                    if not is_dummy(m.group()):
                        self.add(*m.span(), kind)
        if "://" in text:
            for m in _ADDRESS.finditer(text):
                if not is_dummy(unquote(m.group(2))):
                    self.add(*m.span(2), "password in an address")
        if "-u" in text:
            for m in _USERPASS.finditer(text):
                if not is_dummy(m.group(2)):
                    self.add(*m.span(2), "user and password")
        low = text.lower()
        if "basic" in low or "bearer" in low or "token" in low:
            self.schemes()
        self.literals()
        if "&quot;" in text or "&apos;" in text or "&#3" in text:
            for m in _HTML.finditer(text):
                if name_kind(m.group(1)) == "secret" and is_secret_value(html.unescape(m.group(3))):
                    self.add(*m.span(3), "value of a secret")
        self.unquoted()
        self.encoded()

    def keys(self) -> None:
        text = self.text
        begins = list(_PEM.finditer(text))
        ends = [m.start() for m in _PEM_END.finditer(text)]
        for k, m in enumerate(begins):
            until = begins[k + 1].start() if k + 1 < len(begins) else len(text)
            at = bisect_left(ends, m.end())
            end = ends[at] if at < len(ends) and ends[at] <= until else min(until, _armour_end(text, m.end()))
            body = re.sub(r"\\[nrt]|[^A-Za-z0-9+/=*xX]", "", text[m.end() : end])
            if len(body) >= 16 and len(set(body)) > 6:
                self.spans.append((m.start(), end, "private key"))

    def schemes(self) -> None:
        text = self.text
        headers = None
        for m in _SCHEME.finditer(text):
            scheme, value = m.groups()
            if scheme.lower() == "basic":
                inner = _decoded_text(value)
                if inner and ":" in inner and not is_dummy(inner.split(":", 1)[1]):
                    self.add(*m.span(2), "basic authorization")
            elif is_secret_value(value) and re.search(r"\d", value):
                if headers is None:
                    headers = [h.end() for h in _HEADER.finditer(text)]
                k = bisect_right(headers, m.start())
                line = text.rfind("\n", 0, text.rfind("\n", 0, m.start()) + 1 or 1)  # from the line before on
                if k and headers[k - 1] > line:
                    self.add(*m.span(2), "bearer authorization")

    def literals(self) -> None:
        text = self.text
        found = [(m.start(), m.end(), m.start() + 1, m.end() - 1) for m in _LITERAL.finditer(text)]
        if _INSIDE.search(text):  # apostrophes and back-ticks in prose hide what stands between them
            inner = [(m.start(), m.end(), m.start() + 1, m.end() - 1) for a, b, _, _ in found if text[a] == "`" for m in _QUOTED.finditer(text, a + 1, b - 1)]
            found = sorted(found + inner)
            for m in _DIRECT.finditer(text):
                k = 2 if m.group(2) is not None else 3
                if name_kind(m.group(1)) == "secret" and is_secret_value(m.group(k)):
                    self.add(*m.span(k), "value of a secret")
        i = 0
        while i < len(found):
            start, end, a, b = found[i]
            value, last = text[a:b], i
            while last + 1 < len(found) and _JOIN.fullmatch(text, found[last][1], found[last + 1][0]):
                last += 1
                value += text[found[last][2] : found[last][3]]
            hit = None
            if last > i:  # a literal in pieces is judged as a whole
                hit = next((kind for kind, _, p in FORMATS if (m := p.search(value)) and not is_dummy(m.group())), None)
                if hit is None and (m := _ADDRESS.search(value)) and not is_dummy(unquote(m.group(2))):
                    hit = "password in an address"
            secret = is_secret_value(value)
            if hit is None and (secret or is_passphrase(value)):
                line = max(text.rfind("\n", 0, start) + 1, found[i - 3][0] if i > 2 else 0)
                before = text[line:start]
                if last > i and not before.strip() and (m := _OPENED.search(text, max(text.rfind("\n", 0, max(0, line - 1)) + 1, found[i - 1][1] if i else 0), start)):
                    before = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
                names = self.names(before, text, found[last][1])
                kinds = [name_kind(n) for n in names]
                if "secret" in kinds and "plain" not in kinds and (secret or names[0].lower().endswith(("passphrase", "mnemonic"))):
                    hit = "value of a secret"
            if hit:
                for k in range(i, last + 1):
                    self.add(found[k][2], found[k][3], hit if k == i else "rest")
            elif "\\" in value:
                self.escaped(value, a, b)
            i = last + 1

    def names(self, before: str, text: str, after: int) -> list[str]:
        if m := _VALUE_BEFORE.search(before):
            return [m.group(1)]
        names = [m.group(1) for p in (_DEFAULT_BEFORE, _ENV_BEFORE) if (m := p.search(before))]
        if names:
            return names
        if m := _KEY_BEFORE.search(before):
            return [m.group(2)]
        if m := _NAME_BEFORE.search(before):
            return [m.group(1)]
        if _ANNOTATION_BEFORE.search(before) and (m := _NAME_AFTER.match(text, after)):
            return [m.group(1)]
        if m := _CALL_BEFORE.search(before):
            return [m.group(1)]
        return []

    def unquoted(self) -> None:
        for k, (pattern, hints) in enumerate(zip(_PLAIN, _PLAIN_HINTS)):
            if not any(h in self.text for h in hints):
                continue
            for m in pattern.finditer(self.text):
                name, value = m.groups()
                if k == 0 and re.search(r"[;{(\[]$|^[\[{(]|^\w+(?:\.\w+)*[(\[]", value) and not re.search(r"\d", value):
                    continue
                if k == 0:
                    value = re.sub(r"[;,]$", "", value)
                signs = k == 4 and _SIGNATURE.fullmatch(name) and len(value) >= 16
                if (name_kind(name) == "secret" or signs) and is_secret_value(unquote(value) if k == 4 else value):
                    self.add(m.start(2), m.start(2) + len(value), "value of a secret")

    def escaped(self, value: str, a: int, b: int) -> None:
        inner = re.sub(r"\\([\"'`/\\])", r"\1", value)
        if inner != value and (found := _Scan(inner).spans):
            self.add(a, b, found[0][2])

    def encoded(self) -> None:
        text, known = self.text, _merged([x[:2] for x in self.spans])
        done = 0
        for m in _ENCODED.finditer(text):
            start, end = m.span()
            if start < done or _covers(self.quiet, start) or _covers(known, start):
                continue
            token, last = m.group(), end
            if len(token) >= 40 and "%" not in token and "\\" not in token:  # base64 over several lines
                pieces = [token]
                while (w := _WRAP.match(text, last)) and not pieces[-1].endswith("="):
                    pieces.append(w.group(1))
                    last = w.end()
                    if len(w.group(1)) < len(token):
                        break
                if len(pieces) > 1 and (kind := self.behind("".join(pieces))):
                    self.add(start, last, kind)
                    done = last
                    continue
            if kind := self.behind(token):
                self.add(start, end, kind)

    def behind(self, token: str) -> str | None:
        """The kind of credential the token is an encoding of, or None."""
        for data in _layers(token):
            if kind := key_container(data):
                return kind
            if (inner := _text_of(data)) and (found := _Scan(inner).spans):
                return found[0][2]
        return None


def find(text: str | None) -> list[tuple[int, int, str]]:
    """Merged spans (start, end, kind) of the credentials of a text, in order."""
    if not text:
        return []
    out: list[list] = []
    for a, b, kind in sorted(_Scan(text).spans, key=lambda s: (s[0], -s[1])):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b, kind])
    return [tuple(x) for x in out]


def lines(text: str | None, found: list[tuple[int, int, str]] | None = None) -> list[tuple[int, str]]:
    """(line, kind) of each line on which a credential begins."""
    seen: dict[int, str] = {}
    at, line = 0, 1
    for a, _, kind in find(text) if found is None else found:
        line += text.count("\n", at, a)
        at = a
        if kind != "rest":
            seen.setdefault(line, kind)
    return list(seen.items())


_KEEP = re.compile(r"-----(?:BEGIN|END) [A-Z0-9 ]+-----|\\[nrt]|[\s\"'`+#/*|>,-]")


def mask(text: str | None, found: list[tuple[int, int, str]] | None = None) -> str | None:
    """The text with every credential masked and all else as it was."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in find(text) if found is None else found:
        out.append(text[at:a])
        if text.startswith("-----BEGIN", a):
            head = text.index("-----", a + 10) + 5
            out.append(text[a:head] + re.sub(r"\\[nrt]|[A-Za-z0-9+/=]", lambda m: m.group() if m.group()[0] == "\\" else "*", text[head:b]))
        else:
            out.append(re.sub(r"[^\n\r]", "*", text[a:b]))
        at = b
    return "".join(out) + text[at:]


def findings(files: DataFrame, key: str = "file_id", content: str = "content") -> DataFrame:
    """file_id, line, kind of each line on which a credential begins, once per line."""

    def run(batches):
        schema = pa.schema([("file_id", pa.int64()), ("line", pa.int32()), ("kind", pa.string())])
        for b in batches:
            out = [(k, *hit) for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for hit in lines(text)]
            if out:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    scanned = spread_scan(files.select(F.col(key).cast("long").alias("file_id"), F.col(content).alias("content"))).mapInArrow(run, "file_id long, line int, kind string")
    return scanned.groupBy("file_id", "line").agg(F.min("kind").alias("kind"))


def redacted(files: DataFrame, key: str = "file_id", content: str = "content") -> DataFrame:
    """All rows of the files, with the content masked: file_id, content, n_masked."""

    def run(batches):
        schema = pa.schema([("file_id", pa.int64()), ("content", pa.string()), ("n_masked", pa.int32())])
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [find(t) for t in texts]
            masked = pa.array([mask(t, f) for t, f in zip(texts, found)], pa.string())
            yield pa.record_batch([b.column(0).cast(pa.int64()), masked, pa.array([len(lines(t, f)) for t, f in zip(texts, found)], pa.int32())], schema=schema)

    return spread_scan(files.select(F.col(key).cast("long").alias("file_id"), F.col(content).alias("content"))).mapInArrow(run, "file_id long, content string, n_masked int")
