"""Per-text rules of the credential operator: candidates, layered decoding, key containers.

Plain Python helpers that run inside Spark tasks; ``secrets.py`` distributes them.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from urllib.parse import unquote

import ahocorasick

# ---- fixed values: names, formats and placeholders (public formats, plain lists) ----

#: Endings of a name that make it the name of a credential.
SECRET_ENDINGS = (
    "password", "passwd", "passwrd", "passphrase", "passcode", "pass", "pwd", "pw", "secret", "token",
    "credential", "credentials", "creds", "cred", "auth", "bearer", "authorization", "psk", "sig", "apikey", "secretkey",
    "accesskey", "privatekey", "clave", "contrasena", "contraseña", "senha", "motdepasse", "passwort",
    "kennwort", "heslo", "haslo", "hasło", "parol", "parola", "sifre", "şifre", "wachtwoord", "losenord",
    "koulin", "kouling", "mima", "пароль", "密码", "口令", "パスワード", "암호", "비밀번호",
)
#: Words before "key" that make the key a credential.
KEY_KINDS = {
    "api", "access", "secret", "private", "priv", "signing", "sign", "encryption", "encrypt", "account", "hmac",
    "salt", "master", "auth", "service", "storage", "shared", "ssh", "rsa", "aes", "crypto", "client", "deploy",
    "license", "cookie", "session", "jwt", "app", "webhook", "sas", "decryption", "cipher", "token", "pass",
}
#: Words after a name that say nothing about its kind.
NEUTRAL_TAILS = {
    "b64", "base64", "enc", "encoded", "hex", "raw", "value", "val", "str", "string", "text", "old", "new", "prod",
    "dev", "staging", "stage", "test", "live", "a", "b", "c", "x", "64", "32", "plain", "default", "env", "tmp",
}
#: Letters by which a line is taken up for a closer look.
NAME_TRIGGERS = (
    "pass", "pwd", "pw", "secret", "token", "key", "auth", "cred", "bearer", "psk", "sig", "clave", "contrase", "senha", "passe",
    "kennwort", "heslo", "haslo", "hasło", "parol", "sifre", "şifre", "wachtwoord", "koulin", "mima", "пароль",
    "密码", "口令", "パスワード", "암호", "비밀번호", "login", "basic ",
)
#: Token formats that issuers publish, and the common shape "vendor, mark, long random part".
TOKEN_FORMATS = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{22,}"
    r"|glpat-[\w-]{20,}|xox[abeprs]-[A-Za-z0-9-]{12,}|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}|AIza[\w-]{30,}"
    r"|sk-(?:ant-|proj-)?[A-Za-z0-9_-]{20,}|SG\.[\w-]{16,}\.[\w-]{16,}|hf_[A-Za-z0-9]{30,}|npm_[A-Za-z0-9]{30,}"
    r"|pypi-[\w-]{40,}|dop_v1_[0-9a-f]{40,}|ya29\.[\w-]{20,}|EAACEdEose0cBA\w+|AGE-SECRET-KEY-1[0-9A-Z]{50,}"
    r"|eyJ[\w-]{8,}\.eyJ[\w-]{8,}(?:\.[\w-]*)?|[a-z]{2,6}_(?:live|test|prod|secret)_[A-Za-z0-9]{16,}"
    r"|(?!sha|md|rev|sum)[a-z]{2,5}-[0-9a-f]{32,}(?![0-9A-Za-z-])"
    r"|[a-z]{2,5}\.(?=[A-Za-z0-9]*\d)(?=[A-Za-z0-9]*[A-Z])[A-Za-z0-9]{16,}\.[A-Za-z0-9_-]{8,})"
)
PLACEHOLDER_WORDS = {
    "password", "passwd", "secret", "token", "bearer", "basic", "none", "null", "nil", "true", "false", "test",
    "undefined", "empty", "string", "required", "optional", "default", "foobar", "foo", "bar", "baz", "username",
    "changeit", "admin", "user", "value", "unset", "disabled", "enabled", "apikey", "api_key", "api-key",
}
PLACEHOLDER_PARTS = re.compile(
    r"(?i)example|placeholder|change[-_ ]?me|dummy|your[-_ ]|_here\b|here>|todo|fixme|redacted|masked|sample[-_]"
    r"|insert[-_ ]|replace[-_ ]|lorem|not[-_]?set|removed|<[^>]*>|\*{3,}|•{3,}|…|\.{3,}$|\[[a-z ]+\]$"
)
#: Words that make the body of a key a stand-in even where its letters are base64.
STAND_IN = re.compile(r"(?i)example|placeholder|change[-_ ]?me|dummy|redacted|lorem")
REFERENCES = re.compile(
    r"^(?:\$\{?[A-Za-z_][\w.:-]*\}?|\$\(.*\)|\$?\{\{.*\}\}|\{[\w.]+\}|%\w+%|%\(\w+\)s?|%[sd]|![A-Za-z_]+|@[\w.]+@?|#\{.*\}"
    r"|(?:vault|env|ssm|kms|file|secret|secrets|keyring|keychain|op|ref\+\w+|arn|projects|secretsmanager)[:/].*"
    r"|(?:process\.env|os\.environ|os\.getenv|System\.getenv|System\.getProperty|os\.Getenv|ENV|config|settings"
    r"|self|this|ctx|viper|getenv|environ|credentials|secrets|args|opts|params|request|req|input)\b[\w.\[\]()\"'-]*"
    r"|/(?:run|etc|var|mnt|opt|home|usr)/.*|X-[A-Za-z-]+|https?://[^\s@]*)$"
)
UUID = re.compile(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
WORDY_PATH = re.compile(r"^[A-Za-z_.~-]*(?:[/\\][A-Za-z_.~-]+)+$")
#: Digests and images that only look like secrets.
DIGESTS = re.compile(r"^(?:sha(?:1|256|384|512)|md5)[-:]|^data:|^ssh-(?:rsa|ed25519|dss) |^\$2[aby]\$")

# ---- patterns of the places where credentials stand ----

PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|PuTTY-User-Key-File-\d")
#: Breaks of armoured lines, real or written as escapes or markup.
ARMOUR_BREAK = re.compile(r"\r?\n|(?<!\\)(?:\\++(?:[nr]|(?:x0|u000)[adAD]))+|<br ?/?>|&#(?:10|13|x[aAdD]);|(?:%0[adAD])+")
#: What may stand around an armoured line: comment and quote marks, indents, commas of lists.
WRAP = r"[\s>|*#/;,+.\\()\[\]{}<!:&\-]*+(?:\b[rbfuRBFUL]{1,2}(?=[\"'`]))?[\s\"'`+.,;\\()\[\]{}*|#/<>&:\-]*+"
ARMOUR_DATA = re.compile(rf"{WRAP}(?P<data>(?:[A-Za-z0-9+/_=-]{{16,}}+[ \t]++)*+[A-Za-z0-9+/_=-]*+){WRAP}")
ARMOUR_HEADER = re.compile(
    rf"{WRAP}(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID|Encryption|Public-Lines|Private-(?:Lines|MAC|Hash)"
    r"|Key-Derivation|Argon2-\w+|X-[\w-]+)[ \t]*:[^\n]*"
)
ARMOUR_OPEN_DATA = re.compile(rf"{WRAP}[A-Za-z0-9+/]{{16,}}={{0,2}}(?=[\"'`])")
PUTTY_KIND = re.compile(r"(?::[ \t]*[\w-]*)?")
GLUE_WORD = re.compile(r"\s*(\$?[\w.]+)")
ARMOUR_MARK = re.compile(r"-----(BEGIN|END)[^\n-]*(?:-----)?|PuTTY-User-Key-File-\d")
#: Where a string literal stops and its next piece on the following line begins.
JOINT = re.compile(r"([\"'])[ \t]*+[+.]?[ \t]*+\\?\r?\n[ \t]*+[+.]?[ \t]*+[rbfuRBFUL]{0,2}\1")
#: The same on one line, where only redaction looks for it.
JOINT_BESIDE = re.compile(r"([\"'])[ \t]*+(?:[+.][ \t]*+)?[rbfuRBFUL]{0,2}\1((?:[^\"'\\\n]|\\.)*+)(?=\1)")
NAME = re.compile(r"[\w.\-]*")
WORD = re.compile(r"\w*")
SEPARATOR = re.compile(
    r"[\"'`]?\]?[ \t]*(?::[ \t]*[A-Za-z_][\w.\[\]?]*[ \t]*=(?=[ \t]*[\"'`(\w])(?!=)|:=|=>|=(?![=~])|\|\||\?\?|:(?![:=/]))[ \t]*"
)
PAIR = re.compile(r"[\"']?[ \t]*[,;\n][ \t]*[\"']?value[\"']?[ \t]*[:=][ \t]*", re.I)
VALUE = re.compile(
    r"\(?[ \t]*(?:[rbfuRBFUL]{0,2}(?:\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)')|`([^`\n]*)`|([^\s\"'`,;]+))"
)
URL_USER = re.compile(r"(?<=[A-Za-z0-9+.-])://[^\s/:@\"'`<>]*:([^\s/@\"'`<>]+)@")
OPTION = re.compile(
    r"(?:--?(?:password|passwd|pass|pw|token|secret|api-?key|auth|http-password|proxy-password)[= ]|sshpass -p ?)"
    r"(\"[^\"\n]+\"|'[^'\n]+'|[^\s\"'`;|&]+)"
)
USER_OPTION = re.compile(r"(?:\s-u|--user|--proxy-user)[ =]?[\"']?[\w.@-]+:([^\s\"'`]+)")
MYSQL_OPTION = re.compile(r"\bmysql(?:dump|admin)?\b[^\n]*?\s-p([^\s\"'`]{6,})")
LOGIN = re.compile(
    r"(?:login|log_in|signin|sign_in|authenticate|connect|auth|set_credentials|basic_auth|basicAuth|setPassword)\w*"
    r"\s*\(\s*(?:[\"'][^\"'\n]*[\"']\s*,\s*)?[\"']([^\"'\n]+)[\"']", re.I,
)
SCHEME = re.compile(r"\b(Bearer|Basic)[ \t]+([A-Za-z0-9._~+/=!#$%&*?^@-]{8,})")
ANY_RUN = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{20,}={0,2}")
LONG_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
HEX_RUN = re.compile(r"^(?:[0-9a-fA-F]{2}){8,}$")
PERCENT = re.compile(r"%[0-9a-fA-F]{2}[A-Za-z0-9._~+-]*(?:%[0-9a-fA-F]{2}[A-Za-z0-9._~+-]*)+")
ESCAPED = re.compile(
    r"\\(?:x[2-7][0-9a-fA-F]|u00[2-7][0-9a-fA-F]|[01][0-7]{2})"
    r"(?:[A-Za-z0-9._~+/=-]|\\(?:x[2-7][0-9a-fA-F]|u00[2-7][0-9a-fA-F]|[01][0-7]{2})){3,}"
)
ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|([0-3][0-7]{2}))")
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+")


# ---- names and values ----


def is_secret_name(name: str) -> bool:
    """Whether a variable, field or option of this name holds a credential."""
    low = name.strip("-._").lower()
    last = re.split(r"[.]", name.strip("-._"))[-1]
    words = [w.lower() for w in CAMEL.findall(last)]
    while len(words) > 1 and (words[-1] in NEUTRAL_TAILS or words[-1].isdigit()):
        words.pop()
    if not words:
        return False
    if words[-1] in ("key", "keys"):
        return len(words) > 1 and words[-2] in KEY_KINDS
    joined = "".join(words)
    if words[-1] in SECRET_ENDINGS or joined in SECRET_ENDINGS or low in SECRET_ENDINGS:
        return True
    return len(words[-1]) > 3 and words[-1].endswith(("password", "passwd", "pass", "pwd", "pw", "secret", "token", "apikey"))


def is_secret_value(value: str, quoted: bool) -> bool:
    """Whether a value given to a credential's name is one, and not a stand-in or a reference."""
    v = value.strip()
    if len(v) < 6 or v.isdigit() or len(set(v)) < 4:
        return False
    if " " in v or "\t" in v:
        return False
    if PLACEHOLDER_PARTS.search(v) or REFERENCES.match(v) or DIGESTS.match(v) or WORDY_PATH.match(v):
        return False
    if v.lower() in PLACEHOLDER_WORDS:
        return False
    letters = v.replace("_", "").replace(".", "")
    if not quoted:
        if letters.isalpha() or any(c in v for c in "()[]{}<>"):
            return False
    elif letters.isalpha() and ("_" in v or "." in v or v.islower() and len(v) < 8):
        return False
    return True


# ---- encoded layers and key containers ----


def _tlv(data: bytes, at: int) -> tuple[int, int, int]:
    """Tag, start and end of the DER value at ``at``; raises where the length runs out of the data."""
    tag, n = data[at], data[at + 1]
    at += 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4:
            raise ValueError("length")
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
    if at + n > len(data):
        raise ValueError("length")
    return tag, at, at + n


def _jks(data: bytes) -> bool:
    """Whether a Java key store holds a private key: its entries are walked until one is."""
    version, count = (int.from_bytes(data[i : i + 4], "big") for i in (4, 8))
    at = 12

    def sized(width: int) -> int:
        n = int.from_bytes(data[at : at + width], "big")
        if at + width + n > len(data):
            raise ValueError("length")
        return at + width + n

    for _ in range(count):
        tag, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if tag not in (1, 2, 3) or version not in (1, 2) or at + 10 > len(data):
            return False
        at = sized(2) + 8  # alias and date
        if tag != 2:
            return at < len(data)
        if version == 2:
            at = sized(2)  # kind of certificate
        at = sized(4)
    return False


def key_container(data: bytes) -> str | None:
    """Kind of private key in a binary container: DER (PKCS#1, PKCS#8, PKCS#12, SEC1), OpenSSH or Java key store; None for all else."""
    if data.startswith(b"openssh-key-v1\0"):
        return "openssh"
    if data[:4] in (b"\xfe\xed\xfe\xed", b"\xce\xce\xce\xce"):
        try:
            return "jks" if _jks(data) else None
        except ValueError:
            return None
    try:
        tag, at, end = _tlv(data, 0)
        if tag != 0x30:
            return None
        parts = []
        while at < end and len(parts) < 12:
            tag, start, at = _tlv(data, at)
            parts.append((tag, start, at))
        tags = [p[0] for p in parts]
        version = data[parts[0][1] : parts[0][2]] if tags[:1] == [0x02] else b""
        if tags[:3] == [0x02, 0x30, 0x04] and version in (b"\0", b"\1"):
            return "pkcs8"
        if tags[:2] == [0x30, 0x04] and len(tags) == 2 and data[parts[0][1]] == 0x06:
            return "pkcs8-encrypted"
        if len(tags) >= 9 and set(tags[:9]) == {0x02} and version in (b"\0", b"\1"):
            return "pkcs1"
        if tags[:2] == [0x02, 0x04] and version == b"\1":
            return "sec1"
        if tags[:2] == [0x02, 0x30] and version == b"\3":  # a store whose content is PKCS#7 data
            kind, start, stop = _tlv(data, parts[1][1])
            if kind == 0x06 and data[start:stop].startswith(bytes.fromhex("2a864886f70d0107")):
                return "pkcs12"
    except (IndexError, ValueError):
        pass
    return None


def _text(data: bytes) -> str | None:
    """The text that the bytes are in UTF-8 or UTF-16; None if they are none."""
    wide = data[:2] in (b"\xff\xfe", b"\xfe\xff") or len(data) % 2 == 0 and 2 * data.count(0) >= len(data) - len(data) // 8
    codecs = ("utf-16", "utf-16-le", "utf-16-be") if data[:2] in (b"\xff\xfe", b"\xfe\xff") else ("utf-16-le", "utf-16-be")
    for codec in codecs if wide else ("utf-8",):
        try:
            s = data.decode(codec)
        except UnicodeDecodeError:
            continue
        if len(s) >= 6 and sum(c.isprintable() or c in "\r\n\t" for c in s) == len(s):
            return s
    return None


def _base64(run: str) -> bytes | None:
    run = run.replace("-", "+").replace("_", "/").rstrip("=")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4))
    except (binascii.Error, ValueError):
        return None


def _unescape(text: str) -> str:
    return ESCAPE.sub(lambda e: chr(int(e[3], 8) if e[3] else int(e[1] or e[2], 16)), text)


def _decoded(text: str, runs: list[tuple[int, str]]):
    """``(start, end, content)`` of each encoded literal; content is text or bytes."""
    for at, run in runs:
        for m in LONG_RUN.finditer(run):
            part = m.group()
            data = bytes.fromhex(part) if HEX_RUN.match(part) else _base64(part)
            if data:
                yield at + m.start(), at + m.end(), data
    for mark, pattern, plain in (("%", PERCENT, unquote), ("\\", ESCAPED, _unescape)):
        if mark in text:
            for m in pattern.finditer(text):
                start = m.start()  # letters before the first escape belong to the same literal
                while start and (text[start - 1].isalnum() or text[start - 1] in "._~+-"):
                    start -= 1
                yield start, m.end(), plain(text[start : m.end()])


# ---- scanning ----


def _joined(text: str):
    """The text with adjacent string pieces joined, and a function from its offsets to the text's."""
    if not JOINT.search(text):
        return text, lambda i: i
    out, starts, shifts, last, gone = [], [0], [0], 0, 0
    for m in JOINT.finditer(text):
        out.append(text[last : m.start()])
        gone += m.end() - m.start()
        starts.append(m.end() - gone)
        shifts.append(gone)
        last = m.end()
    out.append(text[last:])
    return "".join(out), lambda i: i + shifts[bisect_right(starts, i) - 1]


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _triggers() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for trigger in NAME_TRIGGERS:
        found.add_word(trigger, trigger)
    found.make_automaton()
    return found


_TRIGGERS = _triggers()


def _named(text: str, low: str):
    """Values that stand after the name of a credential. Every name is looked at once, from left to right."""
    done = called = 0  # ends of the last name and of the last call that were looked at
    for last, trigger in _TRIGGERS.iter(low):
        at = last - len(trigger) + 1
        if trigger == "login" and at >= called:
            called = WORD.match(text, at).end()
            m = LOGIN.match(text, at)
            if m and is_secret_value(m.group(1), True):
                yield *m.span(1), "login"
        if at < done:
            continue
        start = at
        while start > done and (text[start - 1].isalnum() or text[start - 1] in "_.-"):
            start -= 1
        end = done = max(NAME.match(text, at).end(), at + 1)
        name = text[start:end]
        after = SEPARATOR.match(text, end) or PAIR.match(text, end)
        if after and name and is_secret_name(name):
            m = VALUE.match(text, after.end())
            if m and m.lastindex:
                k = m.lastindex
                value = m.group(k)
                s, e = m.span(k)
                if k == 4:
                    value = value.rstrip(")]}")
                    e = s + len(value)
                if is_secret_value(value, k != 4):
                    yield s, e, "named"


def _glue(text: str, at: int) -> re.Pattern:
    """Lines that give another string to what the line of the mark gave it to (``key += "..."``, ``out.append("...")``)."""
    word = GLUE_WORD.match(text, text.rfind("\n", 0, at) + 1, at)
    name = re.escape(word[1]) if word else r"(?!)"
    return re.compile(rf"\s*{name}[\s(+=.<:]*+[rbfuRBFUL]{{0,2}}[\"'`](?P<data>[A-Za-z0-9+/=_-]*+){WRAP}")


def _armour_end(text: str, m: re.Match) -> tuple[int, int]:
    """Ends of the body and of the whole block of a private key whose mark is ``m``.

    The body goes on to the next mark as long as its lines are base64, armour headers or empty, within quotes or
    comment marks. Where that is no END, a line shorter than those before is the last one.
    """
    mark = ARMOUR_MARK.search(text, m.end())
    limit = mark.start() if mark else len(text)
    putty = m.group().startswith("PuTTY")
    closed = bool(mark and mark[1] == "END") and not putty
    glue = _glue(text, m.start())
    at = m.end()
    if putty:  # the rest of its line is the kind of key
        at = PUTTY_KIND.match(text, at).end()
    cut, width, strict = -1, 0, at
    while at <= limit:
        stop = ARMOUR_BREAK.search(text, at, limit)
        line_end = stop.start() if stop else limit
        if (putty or not width) and ARMOUR_HEADER.fullmatch(text, at, line_end):
            strict, cut, width = line_end, -1, 0
        elif data := ARMOUR_DATA.fullmatch(text, at, line_end) or glue.fullmatch(text, at, line_end):
            n = len(data["data"])
            if n and cut < 0:
                if (n >= 16 and n >= width) or n < width:
                    strict = data.end("data")
                    if n < width:
                        cut = strict
                    width = width or n
                else:
                    cut = strict
        else:
            if cut < 0 and (part := ARMOUR_OPEN_DATA.match(text, at, line_end)):
                strict = part.end()
            return strict, strict
        if not stop:
            break
        at = stop.end()
    return (limit, mark.end()) if closed else (strict, strict)


def _armour_data(body: str):
    """Matches of the lines of an armoured body that are data."""
    at = 0
    while at <= len(body):
        stop = ARMOUR_BREAK.search(body, at)
        end = stop.start() if stop else len(body)
        if not ARMOUR_HEADER.fullmatch(body, at, end) and (m := ARMOUR_DATA.fullmatch(body, at, end)) and m["data"]:
            yield m
        if not stop:
            break
        at = stop.end()


def _scan(text: str):
    """Credentials that stand in the text, and what its encoded literals hold."""
    runs = [(m.start(), m.group()) for m in ANY_RUN.finditer(text)]
    yield from _plain(text, runs)
    for start, end, content in _decoded(text, runs):
        if isinstance(content, bytes) and key_container(content):
            yield start, end, "key container"
        elif _holds_one(content):
            yield start, end, "encoded"


def _holds_one(content: str | bytes) -> bool:
    """Whether a decoded literal, or any layer within it, holds a credential. Each layer is shorter than the one around it."""
    layers, seen = [content], set()
    while layers:
        layer = layers.pop()
        if isinstance(layer, bytes):
            if key_container(layer):
                return True
            layer = _text(layer)
        if not layer or layer in seen:
            continue
        seen.add(layer)
        runs = [(m.start(), m.group()) for m in ANY_RUN.finditer(layer)]
        if next(_plain(layer, runs), None):
            return True
        layers += [inner for _, _, inner in _decoded(layer, runs)]
    return False


def _plain(text: str, runs: list[tuple[int, str]]):
    low = _lower(text)
    yield from _named(text, low)
    if "PRIVATE KEY" in text or "PuTTY-User" in text:
        for m in PRIVATE_KEY.finditer(text):
            stop, end = _armour_end(text, m)
            body = text[m.end() : stop]
            data = "".join(part["data"] for part in _armour_data(body))
            if key_container(_base64(data) or b""):
                yield m.start(), end, "private key"
                continue
            flat = re.sub(r"\\n|\\r|\s|[\"'+#*/,\\]|--+", "", body)
            if len(flat) >= 32 and not STAND_IN.search(body) and not PLACEHOLDER_PARTS.search(re.sub(r"[A-Za-z0-9+/=]{16,}", "", body)):
                yield m.start(), end, "private key"
    if "://" in text:
        for m in URL_USER.finditer(text):
            if len(m.group(1)) >= 4 and is_secret_value(m.group(1), True):
                yield *m.span(1), "url"
    if " -u" in text or "--" in text or "sshpass" in text:
        for pattern, kind in ((OPTION, "option"), (USER_OPTION, "option"), (MYSQL_OPTION, "option")):
            for m in pattern.finditer(text):
                v = m.group(1).strip("\"'")
                if is_secret_value(v, True):
                    s = m.start(1) + (m.group(1)[:1] in "\"'")
                    yield s, s + len(v), kind
    if "Bearer" in text or "Basic" in text:
        for m in SCHEME.finditer(text):
            v = m.group(2)
            if m.group(1) == "Basic":
                plain = _text(_base64(v) or b"") if LONG_RUN.match(v) or len(v) >= 8 else None
                if plain and ":" in plain and is_secret_value(plain.split(":", 1)[1], True):
                    yield *m.span(2), "basic"
            elif any(c.isdigit() for c in v) and is_secret_value(v, True):
                yield *m.span(2), "bearer"
    for at, run in runs:
        for m in TOKEN_FORMATS.finditer(run):
            if not PLACEHOLDER_PARTS.search(m.group()):
                yield at + m.start(), at + m.end(), "token"


def find_credentials(text: str | None) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of every credential, in order and without overlaps; [] for null or empty texts.

    Encoded layers are opened until nothing decodes. A value that is split over several adjacent string pieces is one
    credential that begins on its first line.
    """
    if not text:
        return []
    flat, back = _joined(text)
    out: list[tuple[int, int, str]] = []
    for s, e, kind in sorted(_scan(flat), key=lambda x: (x[0], -x[1])):
        s, e = back(s), back(e - 1) + 1
        if out and s < out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e, out[-1][2])
        else:
            out.append((s, e, kind))
    return out


#: What stands in place of a credential: one word that is whole in a string, a name's value, a list, a shell word or a URL.
MARK = "REDACTED"
_TRAILING = re.compile(r"(?:\\[nrt])+$")
_ARMOUR_LINE = re.compile(r"-----(?:BEGIN|END)[^\n-]*(?:-----)?|PuTTY-User-Key-File-\d[^\n\"'\\]*")
_HEADER_VALUE = re.compile(r"[\w-]+[ \t]*:[ \t]*([^\n\"'`\\]*[^\s\"'`\\,;+])")
_LEFT_OVER = re.compile(r"[A-Za-z0-9+/=_]{8,}")


def _key_parts(text: str, start: int, end: int):
    """The places within a key block that are the key's: marks, header values and data; what parts the lines stays."""
    at, glue = start, _glue(text, start)
    while at <= end:
        stop = ARMOUR_BREAK.search(text, at, end)
        line_end = stop.start() if stop else end
        header = ARMOUR_HEADER.fullmatch(text, at, line_end)
        if mark := _ARMOUR_LINE.search(text, at, line_end):
            yield mark.span()
            rest = mark.end()
        elif header:
            if value := _HEADER_VALUE.search(text, at, line_end):
                yield value.span(1)
            rest = line_end
        elif (data := ARMOUR_DATA.fullmatch(text, at, line_end) or glue.fullmatch(text, at, line_end)) and data["data"]:
            yield data.span("data")
            rest = line_end
        else:
            rest = at
        for left in _LEFT_OVER.finditer(text, rest, line_end):
            yield left.span()
        if not stop:
            break
        at = stop.end()


def _value_parts(text: str, start: int, end: int):
    """The pieces of a value between the joints of its string literals, and pieces that go on behind it on its line."""
    at = start
    for m in JOINT.finditer(text, max(0, start - 1), end):
        if m.start() >= at:
            yield at, m.start()
            at = m.end()
    yield at, end
    while m := JOINT_BESIDE.match(text, end):
        yield m.span(2)
        end = m.end()


def _escapes(text: str, at: int) -> bool:
    """Whether an odd number of backslashes stands before ``at``, so that the character there belongs to an escape."""
    n = 0
    while at > n and text[at - n - 1] == "\\":
        n += 1
    return n % 2 == 1


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each credential replaced by ``MARK``, each piece within its own quotes, so that code stays valid.

    A value of several string pieces becomes the mark and empty pieces; a key block becomes a mark a line. Line breaks
    and escapes that close a value stay, so lines keep their numbers.
    """
    out, last = [], 0
    for start, end, _ in found:
        block = PRIVATE_KEY.search(text, start, end)
        first = True
        for s, e in _key_parts(text, start, end) if block else _value_parts(text, start, end):
            s = max(s, last)
            s += _escapes(text, s)  # the letter of an escape that begins before the value
            if tail := _TRAILING.search(text, s, e):
                e = tail.start()
            e -= _escapes(text, e)  # a backslash whose escape ends behind the value
            if e <= s:
                continue
            out += [text[last:s], MARK if first or block else ""]
            last, first = max(e, s), False
    return "".join([*out, text[last:]])
