"""Secret scanning: candidates by byte runs, false positives removed by a random forest."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_blocks

SHORTEST = 12
_BODY = np.zeros(256, bool)
_BODY[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-.~"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
CONTEXT = 40
#: Words that name a secret, words that name harmless values, and words that placeholders hold.
NAMING = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private", "key")
HARMLESS = ("commit", "sha", "md5", "checksum", "digest", "hash", "uuid", "guid", "isbn", "doi", "version", "build", "revision", "card", "phone", "order", "invoice", "href", "src", "id")
PLACEHOLDER = ("example", "sample", "dummy", "placeholder", "changeme", "your", "test", "xxxx", "foobar", "redacted")
DICTIONARY = ("the", "and", "for", "with", "from", "this", "that", "user", "name", "data", "file", "path", "home", "local", "config", "server", "client", "http", "https", "www", "com", "org", "net", "index", "page", "image", "static", "public", "main", "test", "example", "value", "string", "number", "list", "table", "query", "model", "train", "build", "release", "version", "python", "java", "script", "module", "package", "class", "function", "object", "default", "common", "lib", "src", "bin", "usr", "var", "tmp", "log", "error", "debug", "info", "time", "date", "year", "month", "report", "access", "service", "account", "project", "system", "word", "text", "open", "source", "code", "key", "token", "secret", "password", "sample", "dummy", "your", "here", "change")
#: Prefixes that issuers of keys publish.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza", "SG.", "npm_", "pypi-", "eyJ")
_covered = re.compile("|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))))
_DASH = np.zeros(256, bool)
_DASH[45] = True
_LETTER = _UPPER | _LOWER
_MARK = np.zeros(256, bool)
_MARK[[*b"!@#$%^&*?"]] = True
#: Bytes of assignments, quotes and code, which divide a bare password from what is around it.
_DIVIDES = np.zeros(256, bool)
_DIVIDES[[*b"=:\"'`<>(){}[]|\\,;"]] = True
#: First two bytes of an issuer's prefix.
_TWO = np.zeros(1 << 16, bool)
_TWO[[ord(p[0]) << 8 | ord(p[1]) for p in PREFIXES]] = True
_issued = re.compile(b"(?:" + b"|".join(re.escape(p.encode()) for p in PREFIXES) + rb")[0-9A-Za-z+/_.~-]*")
_named = re.compile(b"(?i:" + b"|".join(re.escape(w.encode()) for w in (*NAMING, "passphrase", "pass")) + rb")[0-9A-Za-z_.-]*[\"'`\]]*[ \t]*$")
_value = re.compile(rb"""[=>:]{0,2}[ \t]*(?i:(?:bearer|basic)[ \t]+)?(?:"((?:[^"\\\r\n]|\\.)+)"|'((?:[^'\\\r\n]|\\.)+)'|`([^`\r\n]+)`|["'`]?([^\s"'`]+))""")
#: A password told in a sentence.
_told = re.compile(rb"""[Pp](?:ASSWORD|ASSPHRASE|ass(?:word|phrase|wd)|wd)\s{1,3}(?:is|was)\s{1,3}(?:now\s{1,3})?["'`]?([^\s"'`]+)""")
#: Bytes before a value in which its naming word must begin.
REACH = 64
_next = re.compile(rb"[&,;][\w.-]+=")
_login = re.compile(rb"//[^\s/:@\"'<>]*:([^\s/\"'<>]+)@")


def candidates(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of what may be a secret, each place once; they may overlap, and the forest decides.

    Values after a word of NAMING (within REACH bytes) with = or :, a password that a sentence tells, passwords in URLs
    and keys that begin with an issuer's prefix, whatever their length and characters; bare words of letters, digits and marks; and mixed_runs.
    """
    pointed, bare = pointed_at(data, off), bare_words(data, off)
    own = ~np.isin(bare[0], pointed[0])  # what stands before a value also says where it ends
    s, e = (np.concatenate(x) for x in zip(mixed_runs(data, off), (bare[0][own], bare[1][own]), pointed, strict=True))
    if len(s):
        s, e = np.unique(np.column_stack([s, e]), axis=0).T
    return np.searchsorted(off, s, "right") - 1, s, e


def pointed_at(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values that what stands before them makes candidates: a naming word, a URL's user, an issuer's prefix."""
    raw, found = data.tobytes(), []
    at = np.flatnonzero((data == 58) | (data == 61))
    for k, d in zip(at.tolist(), (np.searchsorted(off, at, "right") - 1).tolist(), strict=True):
        lo, hi = int(off[d]), int(off[d + 1])
        if raw[k : k + 3] == b"://" and (m := _login.match(raw, k + 1, hi)):
            found.append(m.span(1))
        elif _named.search(raw[max(lo, k - REACH) : k]) and (m := _value.match(raw, k + 1, hi)):
            a, b = m.span(m.lastindex)
            if m.lastindex == 4:
                more = _next.search(raw, a, b)
                b = more.start() if more else b
                b = a + len(raw[a:b].rstrip(b",;.)]}>"))
            if a < b:
                found.append((a, b))
    for m in _told.finditer(raw):
        a, b = m.span(1)
        b = a + len(raw[a:b].rstrip(b",;.)]}>"))
        if a < b and np.searchsorted(off, m.start(), "right") == np.searchsorted(off, b - 1, "right"):
            found.append((a, b))
    if len(data) > 1:
        begins = _TWO[data[:-1].astype(np.int64) << 8 | data[1:]]
        begins[1:] &= ~(_LETTER | _DIGIT)[data[:-2]] | np.isin(np.arange(1, len(data) - 1), off)
        at = np.flatnonzero(begins)
        for k, d in zip(at.tolist(), (np.searchsorted(off, at, "right") - 1).tolist(), strict=True):
            if m := _issued.match(raw, k, int(off[d + 1])):
                found.append((k, k + len(m.group().rstrip(b".-~"))))
    return tuple(np.array(found, np.int64).reshape(-1, 2).T)


def bare_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that hold letters, digits and marks other than those of runs, as passwords do."""
    inside = ~SPACE[data] & ~_DIVIDES[data]
    s, e = _runs(inside, off)
    if not len(s):
        return s, e
    d, l, m = (_sums(x[data]) for x in (_DIGIT, _LETTER, _MARK))
    while True:  # marks of the sentence
        tail = np.isin(data[e - 1], np.frombuffer(b".", np.uint8)) & (e - s > 1)
        if not tail.any():
            break
        e = e - tail
    keep = (d[e] > d[s]) & (l[e] > l[s]) & (m[e] > m[s])
    return s[keep], e[keep]


def _sums(m: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(m)])


def _runs(body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, each within one text."""
    first = np.zeros(len(body) + 1, bool)
    first[off] = True
    begins, ends = body.copy(), body.copy()
    if len(body):
        begins[1:] &= ~body[:-1] | first[1:-1]
        ends[:-1] &= ~body[1:] | first[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def mixed_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of key characters, SHORTEST bytes or more, that mix character classes.

    A run needs a digit beside a letter, upper case after lower case twice, or three dashes; digits alone are none.
    """
    s, e = _runs(_BODY[data], off)
    keep = e - s >= SHORTEST
    s, e = s[keep], e[keep]
    if not len(s):
        return s, e
    while len(s):  # full stops and dashes at the end belong to the sentence
        tail = np.isin(data[e - 1], np.frombuffer(b".-~", np.uint8)) & (e - s > SHORTEST)
        if not tail.any():
            break
        e = e - tail
    d, u, l, dash = (_sums(x[data]) for x in (_DIGIT, _UPPER, _LOWER, _DASH))
    digits, upper, lower = d[e] - d[s], u[e] - u[s], l[e] - l[s]
    turn = np.zeros(len(data), bool)
    turn[1:] = _UPPER[data[1:]] & _LOWER[data[:-1]]
    turns = _sums(turn)
    turns = turns[e] - turns[np.minimum(s + 1, e)]
    keep = (upper + lower > 0) & ((digits > 0) | (turns > 1) | (dash[e] - dash[s] > 2))
    return s[keep], e[keep]


FEATURES = ("length", "entropy", "digits", "upper", "lower", "marks", "transitions", "hex", "dictionary", "vowels", "slashes", "dots", "dashes", "assigned", "quoted", "named", "harmless", "placeholder", "prefix", "in_path", "repeats", "uuid", "symbols", "login", "strong", "code", "literal", "spaces", "data_uri", "integrity", "query", "line_start", "line_end", "told")
#: Words that ask for a password outright, and values that are none.
STRONG = ("password", "passwd", "pwd", "passphrase", "secret", "pass")
LITERALS = ("none", "null", "true", "false", "required", "optional", "string", "str", "bytes", "undefined", "nil", "empty", "yes", "no", "missing", "invalid", "expired", "basic", "bearer")
_strong = re.compile(rf"(?:{'|'.join(STRONG)})[a-z0-9_.-]*[\"'`\]]*\s*[=:>]+\s*[\"'`]?$")
_login_before = re.compile(r"://[^\s/:@]*:$")
_line_key = re.compile(r"\s*(?:export\s+|-\s+)?[\"']?[\w.-]+[\"']?\s*[:=]\s*[\"'`]?")
_told_before = re.compile(r"(?:password|passphrase|passwd|pwd)\s+(?:is|was)\s+(?:now\s+)?[\"'`]?$")
_query_before = re.compile(r"://\S*[?&][\w.-]*=?$|://\S*/$")
_uuid = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")


def describe(value: str, before: str, after: str) -> list[float]:
    """FEATURES of a candidate from itself and CONTEXT characters on either side."""
    n = len(value)
    counts = np.bincount(np.frombuffer(value.encode("latin-1", "replace"), np.uint8), minlength=256)
    share = counts[counts > 0] / n
    kinds = [1 if c.isdigit() else 2 if c.isupper() else 3 if c.islower() else 4 for c in value]
    many = [kinds.count(k) / n for k in (1, 2, 3, 4)]
    low, left = value.lower(), before.lower()
    near = left[-24:]
    covered = sum(len(m) for m in _covered.findall(low))
    return [
        n, float(-(share * np.log2(share)).sum()), *many, sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        sum(c in "0123456789abcdef" for c in low) / n, covered / n, sum(c in "aeiou" for c in low) / n, low.count("/"), low.count("."), low.count("-"),
        float(left.rstrip(" \"'")[-1:] in ("=", ":")), float(before[-1:] in ("'", '"')), float(any(w in near for w in NAMING)), float(any(re.search(rf"\b{w}\b", near) for w in HARMLESS)),
        float(any(w in low or w in near for w in PLACEHOLDER)), float(value.startswith(PREFIXES)), float("://" in left.split(" ")[-1] or left[-1:] in ("/", "\\", "@", "?", "&")),
        float(max(share)), float(bool(_uuid.fullmatch(value))),
        sum(c in "!@#$%^&*?" for c in value) / n, float(bool(_login_before.search(left)) and after[:1] == "@"), float(bool(_strong.search(left))),
        float(any(c in value for c in "(){}[]<>") or value[:1] == "$" or after[:1] == "("), float(low in LITERALS or low in DICTIONARY), low.count(" "),
        float("base64," in near[-10:] or "data:" in near and ";" in near), float(bool(re.search(r"sha\d{3}-$", near) or re.match(r"sha(?:1|256|384|512)[-:]", low))),
        float(bool(_query_before.search(left))), float(bool(_line_key.fullmatch(before.rpartition("\n")[2]))), float(after.lstrip(" \"'`,;").startswith("\n") or not after.strip(" \"'`,;")), float(bool(_told_before.search(left))),
    ]


def invented_findings(n: int = 3000, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Labelled findings from a seeded generator of key formats and look-alikes: (features, labels)."""
    rng = np.random.default_rng(seed)
    hexa, upper, base, word = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz"
    some = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    pick = lambda xs: xs[int(rng.integers(0, len(xs)))]
    prose = lambda: " ".join(some(word, int(rng.integers(2, 9))) for _ in range(6))
    human = lambda: "".join(
        [pick([str.title, str.lower, str.upper])(some(word, int(rng.integers(3, 9)))), some("!@#$%^&*_-.", int(rng.integers(0, 3))), some("0123456789", int(rng.integers(1, 5))), pick(["", "", pick("!@#$%&*?"), some(base, 3)])])
    x, y = [], []
    for k in range(n):
        true, after = k % 2, ""
        if true:
            kind = int(rng.integers(0, 11))
            name = pick(["password", "passwd", "secret", "token", "api_key", "apikey", "auth_token", "access_key"])
            gap = pick(["=", ": ", ' = "', '="', "='", " = "])
            value = [lambda: "AKIA" + some(upper, 16), lambda: some(hexa, pick([18, 24, 32, 40])), lambda: some(base, int(rng.integers(12, 41))), lambda: pick(["ghp_", "npm_", "sk_live_"]) + some(base, 36), lambda: some(base + "+/", 40), lambda: "xoxb-" + some("0123456789", 11) + "-" + some(base, 24), lambda: human(), lambda: human(), lambda: pick("-_. ").join(some(word, int(rng.integers(4, 9))) for _ in range(int(rng.integers(3, 6)))), lambda: human(), lambda: pick(["AKIA", "ASIA"]) + some(upper[:26], 16)][kind]()
            bare = kind in (0, 3, 5, 10) and rng.random() < 0.6
            if kind in (6, 7, 8):
                name = pick(["password", "passwd", "pwd", "secret", "passphrase", "DB_PASSWORD", "db_pass", "auth_token"])
                gap = pick(["=", ": ", ' = "', '="', "='", " = ", '": "'])
            before = prose() + " " + ("" if bare else name + gap)
            if kind == 9:
                before, after = prose() + " " + pick(["postgres", "https", "mysql", "amqp", "redis", "ftp"]) + "://" + pick(["admin", "root", "", "app", some(word, 5)]) + ":", "@" + some(word, 6)
        else:
            kind = int(rng.integers(0, 18))
            value, before = [
                lambda: ("-".join(some(hexa, m) for m in (8, 4, 4, 4, 12)), prose() + pick([" id ", " uuid ", " ", " key: "])),
                lambda: (some(hexa, pick([32, 40, 64])), prose() + pick([" commit ", " sha1 ", " md5 ", " checksum: ", " digest="])),
                lambda: ("/".join([pick(DICTIONARY) for _ in range(4)]) + pick(["", "2", ".v1.2"]), prose() + pick([" /", " https://www."])),
                lambda: ("".join(pick(DICTIONARY).title() for _ in range(4)), prose() + " "),
                lambda: (pick(["example", "your", "dummy"]) + pick(["_api_key_1234", "Token123456", "-secret-000"]), prose() + pick([" token=", " api_key: ", " password="])),
                lambda: (f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}T{rng.integers(10, 24)}.{rng.integers(10, 60)}", prose() + " "),
                lambda: (some(word, int(rng.integers(6, 14))) + pick([".", "-", "_"]) + some(word, 5) + str(rng.integers(0, 99)), prose() + pick([" ", " (", " www."])),
                lambda: ("_".join(pick(DICTIONARY) for _ in range(3)) + str(rng.integers(0, 1000)), prose() + pick([" ", " key ", " = "])),
                lambda: (some("0123456789", 4) + "-" + some("0123456789", 4) + "-" + some("0123456789", 4) + pick(["a", "b", "x"]), prose() + pick([" card ", " phone ", " order "])),
                lambda: (pick([*LITERALS, *DICTIONARY, some(word, int(rng.integers(2, 10)))]), prose() + " " + pick(["key", "token", "author", "keyword", "monkey", "private", "auth", "tokens"]) + pick([": ", "=", ' = "', ":"])),
                lambda: (pick([pick(DICTIONARY), some(word, int(rng.integers(3, 10)))]).title(), prose() + " " + pick(["author", "Author", "keynote", "key", "authors", "keyword"]) + pick([": ", " = ", ":"])),
                lambda: (pick(LITERALS), prose() + " " + pick(["password", "secret", "passwd"]) + pick([": ", "=", " = "])),
                lambda: (str(rng.integers(0, 100000)), prose() + " " + pick(["max_tokens", "key", "tokens", "key_size", "auth_level", "password_length", "secret_count"]) + pick([": ", "=", " = "])),
                lambda: (pick([f"get_{some(word, 5)}()", f"os.environ[{some(word, 6)}", "${" + some(word, 6).upper() + "}", f"<{some(word, 5)}>", f"self.{some(word, 6)}", f"config.{some(word, 6)}", f"{some(word, 5)}_{pick(['password', 'token', 'secret', 'key'])}"]), prose() + " " + pick(["password", "token", "secret", "api_key"]) + pick([" = ", "=", ": "])),
                lambda: (" ".join(pick([*DICTIONARY, some(word, 4)]) for _ in range(int(rng.integers(5, 12)))), prose() + " " + pick(["key", "token", "keynote", "author", "private"]) + pick([': "', ' = "'])),
                lambda: (some(word, int(rng.integers(3, 9))) + str(rng.integers(0, 2000)) + "@" + some(word, 6) + pick([".com", ".org", ".net"]), prose() + pick([" ", " mail ", " from "])),
                lambda: (pick([f"#{some(word, 5)}{rng.integers(0, 99)}", f"{rng.integers(1, 99)}%{some(word, 3)}", f"{some(word, 4)}{rng.integers(0, 99)}!", f"@{some(word, 6)}{rng.integers(0, 99)}", f"${rng.integers(1, 99)}{pick('kmb')}"]), prose() + " "),
                lambda: ("-".join(pick([*DICTIONARY, some(word, int(rng.integers(2, 8)))]) for _ in range(int(rng.integers(4, 7)))), prose() + pick([" ", " the ", "/"])),
            ][kind]()
        x.append(describe(value, before[-CONTEXT:], after or (pick([" ", '" ', "\n"]) + prose())))
        y.append(true)
    return np.array(x), np.array(y)


#: Lines of documents as they are written, with what of them is secret between « and »; {..} is filled by a seeded generator. Made
#: up for this purpose; every fifth one (HELD_OUT_LINES) is never trained on.
LINES = (
    "password: «{weak}»\n", "host: {word}\nuser: {word}\npassword: «{human}»\nport: 5432\n", "password=«{weak}»\n", "DB_PASS=«{human}»\nDB_HOST={word}\n", "export API_TOKEN=«{base40}»\n",
    "my password is «{human}», please change it", "The wifi password is «{weak}» for guests.", "the password was «{human}» until May", "your password is now «{human}»\n", "Password is «{human}»",
    'const apiKey = "«{base32}»";', "api_key = '«{hex32}»'\n", '"client_secret": "«{base24}»",', "token: «{base40}»\n", 'auth_token = "«{hex40}»"  # do not share',
    "postgres://{word}:«{human}»@db.{word}.net/{word}", "https://{word}:«{weak}»@{word}.org/repo", "redis://:«{base24}»@cache:6379", "mysql -u root -p {word} --password=«{human}»", "amqp://{word}:«{human}»@queue/",
    "aws_access_key_id = «AKIA{upper16}»\naws_secret_access_key = «{base40}»\n", "Authorization: Bearer «{base40}»\n", "curl -H 'X-Api-Key: «{hex32}»' https://api.{word}.com/v1", "//registry.{word}.org/:_authToken=«npm_{base36}»\n", "GITHUB_TOKEN=«ghp_{base36}»\n",
    "login {word} with pwd: «{weak}»\n", "passphrase: «{word}-{word}-{word}-{word}»\n", 'secret_key_base: "«{hex64}»"\n', "SLACK=«xoxb-{digits11}-{base24}»\n", "smtp_password = «{human}»\n",
    "ADMIN_PASSWORD='«{weak}»'\n", "spring.datasource.password=«{human}»\n", "  - name: PASSWORD\n    value: x\n  password: «{human}»\n", "ftp://{word}:«{human}»@files.{word}.com", "stripe: «sk_live_{base24}»\n",
    "password: required\n", "password: {literal}\n", "The password: it must be long, and nobody may know it", "if the password is {literal} the login fails", "a password is {word} that only you know", "my password is secret, of course", "the passphrase was lost in {word}",
    "token: str\n", "token = next(tokens)\n", "key: {word}\n", "author: {Word}\n", "keywords: {word}, {word}, {word}", "max_tokens={digits4}\n", "secret = os.environ['{word}']\n", "password = getpass.getpass()\n", "password = config.get('{word}')\n",
    "see https://www.{word}.com/watch?v={base11}&list=PL{base32} for the film", "https://www.{word}.com/playlist?list=PL{base32}", "https://{word}.com/p/{base11}/?igshid={base12}", "https://docs.{word}.com/document/d/{base40}/edit", "<img src=\"data:image/png;base64,{base64}{base64}\">",
    "url(data:font/woff2;base64,{base64}{base64})", '<script src="x.js" integrity="sha384-{base64}"></script>', '"integrity": "sha512-{base64}{base24}=="', '{word}@^1.{digits2}: integrity sha512-{base64}', "sha256:{hex64}", "@sha256:{hex64}",
    "commit {hex40}\nAuthor: {Word} {Word}\n", "Merge {hex7} into {hex7}", "md5 = {hex32}\n", "etag: \"{hex32}\"\n", "request id {uuid} failed", '"uuid": "{uuid}",', "session {uuid} closed", "checksum {hex64} matches",
    "utm_source={word}&utm_campaign={word}_{digits4}", "https://{word}.org/search?q={word}+{word}&page={digits2}", "GET /static/{word}.{hex8}.js HTTP/1.1", "/home/{word}/{word}_{digits4}/{word}-v{digits2}.tar.gz", "{word}_{word}_{digits4}.parquet", "{Word}{Word}{Word}Factory extends {Word}{Word}",
    "order {digits11} was sent", "ISBN 978-{digits4}-{digits4}-1", "doi:10.{digits4}/{word}.{digits4}", "{word}{digits4}@{word}.com wrote", "version {digits2}.{digits2}.{digits4}-{hex8}", "model-{word}-{digits2}b-{word}-v{digits2}",
)
HELD_OUT_LINES = LINES[4::5]


def line_findings(lines: tuple[str, ...], n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of all candidates in n documents made of `lines`, in prose and on their own: true are the marked ones."""
    rng = np.random.default_rng(seed)
    letters, base = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    pick = lambda xs: xs[int(rng.integers(0, len(xs)))]
    spoken = lambda k: "".join(pick("bcdfghjklmnprstvw") + pick("aeiou") for _ in range(k))
    word = lambda: pick([pick(DICTIONARY), spoken(int(rng.integers(2, 5)))])
    alphabets = {"base": base, "hex": "0123456789abcdef", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "digits": "0123456789"}

    def fill(m: re.Match) -> str:
        kind, size = m[1], int(m[2] or 0)
        if kind in alphabets:
            return some(alphabets[kind], size)
        if kind == "weak":
            return pick([spoken(int(rng.integers(3, 6))), spoken(2) + spoken(3), some(letters, int(rng.integers(7, 13))), pick(["let", "my", "the", "i"]) + word() + word()])
        if kind == "human":
            return pick([str.title, str.lower])(spoken(int(rng.integers(2, 4)))) + some("!@#$%&*_-.", int(rng.integers(0, 2))) + some("0123456789", int(rng.integers(1, 5))) + pick(["", "!", "x"])
        return {"literal": lambda: pick(LITERALS), "uuid": lambda: "-".join(some(alphabets["hex"], k) for k in (8, 4, 4, 4, 12)), "Word": lambda: word().title(), "word": word}[kind]()

    x, y = [], []
    for _ in range(n):
        line = re.sub(r"\{([A-Za-z]+?)(\d*)\}", fill, pick(lines))
        prose = lambda: " ".join(word() for _ in range(6))
        line = pick([prose() + "\n", prose() + " ", ""]) + line + pick(["\n" + prose(), "" if line.endswith("\n") else " " + prose(), ""])
        parts = re.split("[«»]", line)
        text = "".join(parts).encode()
        ends = np.cumsum([0, *(len(p.encode()) for p in parts)])
        secret = {(int(ends[k]), int(ends[k + 1])) for k in range(1, len(parts), 2)}
        for _, a, b in zip(*(v.tolist() for v in candidates(np.frombuffer(text, np.uint8), np.array([0, len(text)]))), strict=True):
            held = any(a <= c and d <= b or c <= a and b <= d for c, d in secret)
            if held and (a, b) not in secret:
                continue  # a part of a secret, or more than it: neither true nor false
            x.append(describe(text[a:b].decode("latin-1"), text[max(0, a - CONTEXT) : a].decode("utf-8", "ignore"), text[b : b + CONTEXT].decode("utf-8", "ignore")))
            y.append(int((a, b) in secret))
    return np.array(x), np.array(y)


class Forest:
    """Random forest of Gini trees on bootstrap samples, each split over a random choice of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(y), len(y))
            self.trees.append(self._grow(x[rows], y[rows].astype(float), depth, rng))

    def _grow(self, x, y, depth, rng):
        feature, cut, left, right, value = [], [], [], [], []

        def node(rows, level) -> int:
            me = len(feature)
            for column, empty in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (value, float(y[rows].mean()))):
                column.append(empty)
            if level == depth or len(rows) < 6 or value[me] in (0.0, 1.0):
                return me
            best = (np.inf, -1, 0.0)
            for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]))), replace=False):
                order = np.argsort(x[rows, f], kind="stable")
                v, t = x[rows, f][order], np.cumsum(y[rows][order])
                at = np.flatnonzero(v[1:] > v[:-1]) + 1
                if not len(at):
                    continue
                a, b = t[at - 1], t[-1] - t[at - 1]
                cost = a * (1 - a / at) + b * (1 - b / (len(v) - at))
                k = int(cost.argmin())
                if cost[k] < best[0]:
                    best = (float(cost[k]), int(f), float((v[at[k] - 1] + v[at[k]]) / 2))
            if best[1] < 0:
                return me
            goes = x[rows, best[1]] <= best[2]
            if goes.all():  # the cut between two values next to each other is the larger one
                return me
            feature[me], cut[me] = best[1], best[2]
            left[me] = node(rows[goes], level + 1)
            right[me] = node(rows[~goes], level + 1)
            return me

        node(np.arange(len(y)), 0)
        return tuple(np.array(c) for c in (feature, cut, left, right, value))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                goes = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
                at = np.where(inner, np.where(goes, left[at], right[at]), at)
            total += value[at]
        return total / len(self.trees)


@cache
def default_forest() -> Forest:
    """Trained on the generator's findings and on those of LINES but the held-out ones."""
    (a, b), (c, d) = invented_findings(), line_findings(tuple(x for x in LINES if x not in HELD_OUT_LINES), 2500, 5)
    return Forest(np.vstack([a, c]), np.concatenate([b, d]), depth=12)


def fit(findings: DataFrame, most: int = 20000) -> Forest:
    """A forest from labelled findings (value, before, after, label): a bounded sample of `most` rows by hash."""
    rows = findings.where("value is not null and length(value) > 0 and label is not null").orderBy(F.xxhash64("value", "before"), "label").limit(most).collect()
    y = np.array([int(r.label) for r in rows])
    if len(set(y)) < 2:
        return default_forest()
    return Forest(np.array([describe(r.value, (r.before or "")[-CONTEXT:], (r.after or "")[:CONTEXT]) for r in rows]), y)


def find(data: np.ndarray, off: np.ndarray, forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, score) of a block's candidates, places in bytes of their text."""
    text, s, e = candidates(data, off)
    if not len(text):
        return text, s, e, np.zeros(0)
    raw = data.tobytes()
    x = np.empty((len(text), len(FEATURES)))
    for k, (d, a, b) in enumerate(zip(text.tolist(), s.tolist(), e.tolist(), strict=True)):
        before, after = raw[max(int(off[d]), a - CONTEXT) : a], raw[b : min(int(off[d + 1]), b + CONTEXT)]
        x[k] = describe(raw[a:b].decode("latin-1"), before.decode("utf-8", "ignore"), after.decode("utf-8", "ignore"))
    return text, s - off[text], e - off[text], forest.score(x)


def settle(text: np.ndarray, s: np.ndarray, e: np.ndarray, p: np.ndarray, threshold: float):
    """(secrets, rejected), each (text, start, end, score): overlapping secrets are one with the best score, and what
    the forest rejected goes where a secret holds all of it."""
    good: list[tuple] = []
    for d, a, b, q in zip(*(v[p >= threshold].tolist() for v in (text, s, e, p)), strict=True):
        if good and good[-1][0] == d and a < good[-1][2]:
            good[-1] = (d, good[-1][1], max(b, good[-1][2]), max(q, good[-1][3]))
        else:
            good.append((d, a, b, q))
    keys = [g[:2] for g in good]
    bad = []
    for x in zip(*(v[p < threshold].tolist() for v in (text, s, e, p)), strict=True):
        k = bisect_right(keys, x[:2]) - 1
        if k < 0 or good[k][0] != x[0] or good[k][2] < x[2]:
            bad.append(x)
    return good, bad


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_candidates, n_secrets, secrets, rejected), one for each input row, over whole texts.

    secrets and rejected are arrays of (start, end, score), byte offsets in the UTF-8 text: candidates at or above
    the threshold (overlapping ones as one), and the false positives that the forest removed. Not candidates are
    secrets that nothing marks within REACH bytes before them: bare runs under SHORTEST bytes or of one character class, without a naming word,
    a URL, an issuer's prefix, three dashes or letters, digits and marks together. Null, empty and clean texts have empty arrays.
    A null doc_id is carried along, repeated rows give equal rows, extra columns are ignored, an empty table gives
    no rows. A map over rows without a shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(forest or default_forest())
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def compute(batches):
        for batch in batches:
            n = batch.num_rows
            good, bad = [[] for _ in range(n)], [[] for _ in range(n)]
            for lo, _, data, off in text_blocks(batch.column(1), 2 << 20):
                for out, part in zip((good, bad), settle(*find(data, off, model.value), threshold), strict=True):
                    for d, s, e, p in part:
                        out[lo + d].append({"start": s, "end": e, "score": round(p, 4)})
            counts = [pa.array([len(g) + len(b) for g, b in zip(good, bad, strict=True)], pa.int64()), pa.array([len(g) for g in good], pa.int64())]
            yield pa.record_batch([batch.column(0), *counts, pa.array(good, span), pa.array(bad, span)], ["doc_id", "n_candidates", "n_secrets", "secrets", "rejected"])

    kind = "array<struct<start: long, end: long, score: double>>"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(compute, f"doc_id long, n_candidates long, n_secrets long, secrets {kind}, rejected {kind}")


def redact(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """`docs` with every secret of its texts replaced by `mark`; all rows and columns stay, nulls stay null."""
    model = docs.sparkSession.sparkContext.broadcast(forest or default_forest())
    place = docs.columns.index(text_col)

    def compute(batches):
        for batch in batches:
            column = batch.column(place)
            changed: dict[int, str] = {}
            for lo, _, data, off in text_blocks(column, 2 << 20):
                for d, group in groupby(settle(*find(data, off, model.value), threshold)[0], key=lambda g: g[0]):
                    raw, out, at = data[off[d] : off[d + 1]].tobytes(), [], 0
                    for _, s, e, _ in group:
                        out += [raw[at:s], mark.encode()]
                        at = e
                    changed[lo + d] = b"".join([*out, raw[at:]]).decode("utf-8", "replace")
            if changed:
                values = column.to_pylist()
                for k, v in changed.items():
                    values[k] = v
                column = pa.array(values, column.type)
            yield pa.record_batch([column if k == place else batch.column(k) for k in range(batch.num_columns)], docs_columns)

    docs_columns = docs.columns
    return docs.mapInArrow(compute, docs.schema)
