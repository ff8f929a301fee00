"""Secret scans: pattern candidates, then a random forest against false positives.

Candidates are values after ``=`` or ``:``, passwords inside URLs, private-key
blocks, known token forms and long mixed runs of letters and digits.  The forest
looks at a candidate's length, its character transitions (a Markov chain learned
from the labelled findings, and changes of character class), how much of it
dictionary words cover, its path and the words around it.

It is trained from labelled findings: a DataFrame or list of ``Finding`` (value,
text before and after, path, label).  ``labelled_findings`` makes a seeded set of
``FINDINGS`` of them, used where no other is given.

No pattern has an upper length: a value goes on to its delimiter, a key block to
its END line (a block without one is none), and every feature sees all of it.

Defined results: null and empty texts have no findings; a null id or path is
returned as null and read as an empty path; overlapping candidates are one, from
the first start to the last end, under the rule of the one that starts first
(then the stronger rule, then the longer); repeated rows have repeated findings;
texts of any length are scanned whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import trimmed

FINDINGS = 4000
THRESHOLD = 0.5
MASK = "[SECRET]"

# Frequent words for dictionary coverage, and words that speak for or against a secret.
DICTIONARY = (
    "able about access account action active admin after again all also and any api app archive array auth back base before below block body book "
    "build button cache call change char check class clear client cloud code color column common config content context control copy core count "
    "create current data date day default delete demo description detail device digest direct display document domain down each edit element email "
    "end entry error event every example exit export false field file filter find first float font form format found frame from full function "
    "general get global group hash have header height help home host html http icon image import index info init input integer into item java join "
    "json just key label lang last layout left length level library light limit line link list load local lock login long main make map mark max "
    "media member menu message method min mode model module name native new next node not null number object off online only open option order other "
    "output over own package page panel parent part pass password path pattern place plan play point policy port position post process product "
    "profile program project public query range read record ref remote remove render report request reset resource response result return right role "
    "root row run sample save scale schema script search secret section select send server service session set show side sign simple single size "
    "source space standard start state static status step stop store stream string style submit sum support switch system table tag target task team "
    "template test text that the theme this time title token tool top total track tree true type under unit update upload url use user value variable "
    "version video view visible web when where width window with word work world write year your"
).split()
FOR_WORDS = ("password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "accesskey", "private_key", "credential", "auth", "bearer", "signing", "client_secret", "webhook", "key")
AGAINST_WORDS = ("sha1", "sha256", "sha512", "md5", "checksum", "digest", "integrity", "commit", "revision", "uuid", "guid", "example", "sample", "dummy", "placeholder", "test", "fake", "your", "changeme", "image", "png", "href", "version", "etag", "hash", "phone", "card", "order", "isbn", "build", "trace")
FOR_PATHS = (".env", "config", "credential", "secret", ".pem", ".key", "settings", "deploy", ".tfvars")
AGAINST_PATHS = ("test", "example", "sample", "fixture", "doc", ".lock", ".min.", "vendor", "node_modules", ".svg", ".map")
KNOWN = re.compile(
    r"(?:AKIA|ASIA|AGPA|AROA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|AIza[A-Za-z0-9_\-]{35}|glpat-[A-Za-z0-9_\-]{20,}|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|npm_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}"
)
RUN = re.compile(r"[A-Za-z0-9+/_\-.]{16,}={0,2}")
SIGN = re.compile(r"(?<=[\w.\-\"'`\]\s])[=:]>?[ \t]{0,4}[\"'`]?")
VALUE = re.compile(r"[^\s\"'`<>;,&]{6,}")
IN_URL = re.compile(r"://[^\s:/@]+:([^\s/@]{3,})@")
KEY_LINE = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
KEY_NAME = re.compile(r"(?:passw|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer)[A-Za-z0-9_.\-]{0,24}[\"'`\]]{0,2}\s{0,4}$", re.I)
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
_WORD = re.compile(r"[A-Za-z]{3,}")
NEAR = 48


@dataclass
class Finding:
    """A candidate as people label it."""

    value: str
    before: str
    after: str
    path: str
    rule: str
    is_secret: int = 0


def key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """The spans from each BEGIN line to the END line that comes before any other BEGIN."""
    begin = None
    for m in KEY_LINE.finditer(text):
        if m[1] == "BEGIN":
            begin = m.start()
        elif begin is not None:
            yield begin, m.end()
            begin = None


def assignments(text: str) -> list[tuple[int, int]]:
    """The spans of the values that follow a key name and a sign.

    Every sign is looked at, also those inside a value.  A value that holds a
    further assignment is cut before that one's key name; the parts are values.
    """
    found: list[tuple[int, int]] = []
    run = 0  # where the value characters that the last value begins end
    for sign in SIGN.finditer(text):
        key = KEY_NAME.search(text, max(0, sign.start() - NEAR), sign.start())
        if key is None:
            continue
        start = sign.end()
        if start >= run:
            value = VALUE.match(text, start)
            if value is None:
                continue
            run = value.end()
        elif run - start < 6:
            continue
        if found and key.start() < found[-1][1]:
            found[-1] = (found[-1][0], max(found[-1][0], key.start()))
        found.append((start, run))
    return [(a, a + len(text[a:b].rstrip(".)]}"))) for a, b in found]


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, rule) of the candidates, in order, none overlapping."""
    found: list[tuple[int, int, int, str]] = []
    for m in KNOWN.finditer(text):
        found.append((m.start(), m.end(), 0, "known"))
    if "-----BEGIN" in text:
        found += [(a, b, 0, "key_block") for a, b in key_blocks(text)]
    if "://" in text:
        found += [(m.start(1), m.end(1), 0, "url") for m in IN_URL.finditer(text)]
    if "=" in text or ":" in text:
        found += [(a, b, 1, "assigned") for a, b in assignments(text)]
    for m in RUN.finditer(text):
        value = m[0].strip(".-/")
        digits = sum(map(value.count, string.digits))
        if digits >= 2 and digits < len(value) and len(value) >= 16:
            at = m.start() + m[0].index(value)
            found.append((at, at + len(value), 2, "run"))
    found.sort(key=lambda f: (f[0], f[2], -f[1]))
    kept: list[tuple[int, int, str]] = []
    for start, end, _, rule in found:
        if kept and start < kept[-1][1]:
            kept[-1] = (kept[-1][0], max(end, kept[-1][1]), kept[-1][2])
            continue
        if end > start:
            kept.append((start, end, rule))
    return kept


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


_WORDS = frozenset(DICTIONARY)


def coverage(value: str) -> float:
    """The part of the value that dictionary words of three letters or more cover, longest first."""
    text, covered, at = value.lower(), 0, 0
    while at < len(text):
        step = next((n for n in range(min(11, len(text) - at), 2, -1) if text[at : at + n] in _WORDS), 0)
        covered += step
        at += step or 1
    return covered / max(1, len(text))


@dataclass
class Markov:
    """Log ratio of character transitions in secrets against other candidates."""

    ratio: np.ndarray = field(default_factory=lambda: np.zeros((96, 96)))

    @staticmethod
    def codes(value: str) -> np.ndarray:
        raw = np.frombuffer(value.encode("ascii", "replace"), np.uint8).astype(np.int64) - 32
        return np.clip(raw, 0, 95)

    @classmethod
    def learn(cls, findings: list[Finding]) -> Markov:
        counts = np.full((2, 96, 96), 0.2)
        for f in findings:
            c = cls.codes(f.value)
            np.add.at(counts[f.is_secret], (c[:-1], c[1:]), 1)
        logs = np.log(counts / counts.sum(2, keepdims=True))
        return cls(logs[1] - logs[0])

    def score(self, value: str) -> float:
        c = self.codes(value)
        return float(self.ratio[c[:-1], c[1:]].mean()) if len(c) > 1 else 0.0


FEATURES = ("log_length", "digits", "upper", "lower", "symbols", "entropy", "class_changes", "transitions", "coverage", "longest_letters", "hex", "uuid", "assigned", "known", "block_or_url", "for_words", "against_words", "path_for", "path_against", "quoted", "distinct", "against_in_value", "alone")


def features(f: Finding, markov: Markov) -> list[float]:
    value = f.value
    n = max(1, len(value))
    kinds = [_kind(c) for c in value]
    share = [kinds.count(k) / n for k in (2, 1, 0, 3)]
    counts = np.array(list(Counter(value).values()), float) / n
    entropy = float(-(counts * np.log2(counts)).sum())
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n
    before, after, path, low = f.before[-NEAR:].lower(), f.after[:NEAR].lower(), (f.path or "").lower(), value.lower()
    letters = max((len(m) for m in _WORD.findall(value)), default=0) / n
    return [
        math.log(n), *share, entropy, changes, markov.score(value), coverage(value), letters,
        float(all(c in "0123456789abcdefABCDEF" for c in value)), float(UUID.fullmatch(value) is not None),
        float(f.rule == "assigned"), float(f.rule == "known"), float(f.rule in ("key_block", "url")),
        float(any(w in before for w in FOR_WORDS)), float(any(w in before or w in after[:16] for w in AGAINST_WORDS)),
        float(any(w in path for w in FOR_PATHS)), float(any(w in path for w in AGAINST_PATHS)),
        float(f.before[-1:] in "\"'`" and bool(f.before)), len(counts) / n, float(any(w in low for w in AGAINST_WORDS[11:])),
        float(not f.before.strip()),
    ]


class Forest:
    """Classification trees on bootstrap samples with a random third of the features at each split."""

    def __init__(self, trees: int = 40, depth: int = 12, least: int = 2, seed: int = 11):
        self.trees, self.depth, self.least, self.seed = trees, depth, least, seed
        self.nodes: list[np.ndarray] = []  # rows: feature (-1: leaf), threshold, left, right, probability

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        for _ in range(self.trees):
            rows = rng.integers(0, len(x), len(x))
            grown: list[list[float]] = []
            self._grow(x[rows], y[rows], 0, grown, rng)
            self.nodes.append(np.array(grown))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, out: list[list[float]], rng: np.random.Generator) -> int:
        me = len(out)
        out.append([-1, 0, 0, 0, (y.sum() + 0.5) / (len(y) + 1)])
        if depth >= self.depth or len(y) < 2 * self.least or y.min() == y.max():
            return me
        best = (1e-9, -1, 0.0)
        impurity = len(y) * y.mean() * (1 - y.mean())
        for j in rng.permutation(x.shape[1])[: max(1, x.shape[1] // 3)]:
            order = np.argsort(x[:, j], kind="stable")
            v, ones = x[order, j], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            cut = cut[(cut >= self.least) & (len(y) - cut >= self.least)]
            if not len(cut):
                continue
            left, right = ones[cut - 1], ones[-1] - ones[cut - 1]
            cost = left * (1 - left / cut) + right * (1 - right / (len(y) - cut))
            at = int(cost.argmin())
            if impurity - cost[at] > best[0]:
                best = (impurity - cost[at], int(j), (v[cut[at] - 1] + v[cut[at]]) / 2)
        if best[1] < 0:
            return me
        goes = x[:, best[1]] <= best[2]
        out[me][:2] = best[1], best[2]
        out[me][2] = self._grow(x[goes], y[goes], depth + 1, out, rng)
        out[me][3] = self._grow(x[~goes], y[~goes], depth + 1, out, rng)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                j = t[at, 0].astype(np.int64)
                inner = j >= 0
                goes = x[rows, np.maximum(j, 0)] <= t[at, 1]
                at = np.where(inner, np.where(goes, t[at, 2], t[at, 3]).astype(np.int64), at)
            total += t[at, 4]
        return total / max(1, len(self.nodes))


class Detector:
    """The trained forest with its transition chain."""

    def __init__(self, findings: list[Finding]):
        self.markov = Markov.learn(findings)
        x = np.array([features(f, self.markov) for f in findings], float)
        self.forest = Forest().fit(x, np.array([f.is_secret for f in findings], float))

    def score(self, findings: list[Finding]) -> np.ndarray:
        if not findings:
            return np.zeros(0)
        return self.forest.predict(np.array([features(f, self.markov) for f in findings], float))

    def scan(self, text: str | None, path: str | None = None) -> list[tuple[int, int, str, float]]:
        """(start, end, rule, score) in code points."""
        if not text:
            return []
        spans = candidates(text)
        found = [Finding(text[a:b], text[max(0, a - NEAR) : a], text[b : b + NEAR], path or "", rule) for a, b, rule in spans]
        return [(*span, float(s)) for span, s in zip(spans, self.score(found), strict=True)]


class _Maker:
    """Random parts of labelled findings."""

    HEX, ALNUM, BASE64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    SYLLABLES = "an ber cion de el fer ge hin is ka lo men no ou pra que re ste ti un ver wa za ó é".split()
    LEET = str.maketrans("aeios", "4310$")

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, *options):
        return options[int(self.rng.integers(len(options)))]

    def size(self, low: int, high: int) -> int:
        return int(self.rng.integers(low, high + 1))

    def chars(self, alphabet: str, low: int, high: int | None = None) -> str:
        return "".join(alphabet[i] for i in self.rng.integers(0, len(alphabet), self.size(low, high or low)))

    def known(self) -> str:
        return self.pick(*DICTIONARY)

    def word(self) -> str:
        return self.known() if self.rng.random() < 0.4 else "".join(self.pick(*self.SYLLABLES) for _ in range(self.size(1, 4)))

    def prose(self, k: int = 5) -> str:
        return " ".join(self.word() for _ in range(k)) + self.pick(" ", " ", ". ", ", ", "\n")

    def ident(self) -> str:
        return "".join(self.known().title() for _ in range(self.size(2, 4))) + self.chars(string.digits, 0, 4)

    def named(self, *names: str) -> str:
        """Prose, a key name in one of its spellings, a sign and perhaps a quote."""
        name = self.pick(*names)
        name = self.pick(name, name.upper(), f"{self.known()}_{name}", f'"{name}"', name)
        return self.prose(self.size(1, 4)) + name + self.pick("=", " = ", ": ", ":", " => ") + self.pick("", "", '"', "'")


#: Forms of secrets: what makes (value, text before, rule) of one.
SECRET_FORMS: dict[str, Callable[[_Maker], tuple[str, str, str]]] = {
    "cloud key id": lambda m: (m.pick("AKIA", "ASIA") + m.chars(string.ascii_uppercase + "234567", 16), m.pick(m.prose(), "aws_access_key_id = "), "known"),
    "code host token": lambda m: (m.pick("ghp_", "gho_", "ghs_") + m.chars(m.ALNUM, 36), m.pick(m.prose(), 'GITHUB_TOKEN="', "Authorization: token "), "known"),
    "build host token": lambda m: ("glpat-" + m.chars(m.ALNUM + "_-", 20), m.pick(m.prose(), "PRIVATE-TOKEN: "), "known"),
    "chat token": lambda m: (m.pick("xoxb-", "xoxp-") + m.chars(string.digits, 11) + "-" + m.chars(m.ALNUM, 24), m.pick(m.prose(), "slack: "), "known"),
    "payment key": lambda m: (m.pick("sk_live_", "rk_live_") + m.chars(m.ALNUM, 24, 32), m.pick(m.prose(), 'stripe_key = "'), "known"),
    "maps key": lambda m: ("AIza" + m.chars(m.ALNUM + "_-", 35), m.pick(m.prose(), "key="), "known"),
    "mail key": lambda m: ("SG." + m.chars(m.ALNUM + "_-", 22) + "." + m.chars(m.ALNUM + "_-", 43), m.prose(), "known"),
    "signed token": lambda m: ("eyJ" + m.chars(m.ALNUM, 20, 40) + "." + m.chars(m.ALNUM, 40, 90) + "." + m.chars(m.ALNUM + "_-", 43), m.pick(m.prose(), "Bearer "), "known"),
    "hex token": lambda m: (m.chars(m.HEX, 40), m.named("token", "api_token", "auth_token"), "assigned"),
    "hex secret": lambda m: (m.chars(m.HEX, 32, 64), m.named("secret", "client_secret", "signing_secret", "api_key"), "assigned"),
    "hex password": lambda m: (m.chars(m.HEX, 10, 24), m.named("password", "passwd", "pwd"), "assigned"),
    "mixed password": lambda m: (m.chars(m.ALNUM + "!#%*_", 8, 24), m.named("password", "db_password", "passphrase", "pwd"), "assigned"),
    "word and digits": lambda m: (m.pick(str.title, str.lower)(m.word() + m.pick("", m.word())) + m.chars(string.digits, 2, 4) + m.pick("", *"!#$%*"), m.named("password", "passwd", "pwd"), "assigned"),
    "letters as digits": lambda m: (m.pick(str.title, str.lower)(m.word() + m.pick("", m.word())).translate(m.LEET) + m.pick("", "!", "1", "#22"), m.named("password", "passwd", "secret"), "assigned"),
    "words and digits": lambda m: (m.pick("-", ".", "_").join([m.known(), m.known(), m.known() + m.chars(string.digits, 1, 3)]), m.named("passphrase", "password"), "assigned"),
    "common password": lambda m: (m.pick("passw0rd", "p@ssw0rd", "qwerty12", "letmein1", "welcome1", "admin123", "abc12345", "iloveyou2", "monkey99", "dragon77", "trustno1", "sunshine1").replace("p", m.pick("p", "P"), 1) + m.pick("", "", "!", "1", "2024"), m.named("password", "passwd", "pwd"), "assigned"),
    "cloud secret": lambda m: (m.chars(m.BASE64, 40), m.named("aws_secret_access_key", "secretAccessKey", "secret_key"), "assigned"),
    "api key": lambda m: (m.chars(m.ALNUM, 20, 48), m.named("api_key", "apikey", "access_token", "private_key"), "assigned"),
    "account key": lambda m: (m.chars(m.BASE64, 43, 86) + m.pick("=", "=="), m.named("access_key", "accountauth", "credential"), "assigned"),
    "long key": lambda m: (m.chars(m.BASE64, 300, 1800), m.named("private_key", "secret"), "assigned"),
    "dashed token": lambda m: ("-".join(m.chars(m.ALNUM, 5, 8) for _ in range(m.size(3, 5))), m.named("token", "secret", "auth"), "assigned"),
    "url password": lambda m: (m.chars(m.ALNUM + m.pick("", "_-", "!%*"), 8, 20), m.prose(2) + m.pick("postgres://admin:", "mysql://root:", "amqp://svc:", "https://bot:"), "url"),
    "long url password": lambda m: (m.chars(m.ALNUM + "_-", 40, 220), m.prose(2) + m.pick("postgres://admin:", "mongodb://app:", "https://x-token:"), "url"),
    "rsa block": lambda m: ("-----BEGIN RSA PRIVATE KEY-----\n" + m.chars(m.BASE64, 64, 400) + "\n-----END RSA PRIVATE KEY-----", m.prose(2), "key_block"),
    "pgp block": lambda m: ("-----BEGIN PGP PRIVATE KEY BLOCK-----\n\n" + m.chars(m.BASE64, 64, 900) + "\n-----END PGP PRIVATE KEY BLOCK-----", m.prose(2), "key_block"),
    "bare key": lambda m: (m.chars(m.BASE64, 32, 64), m.prose(4), "run"),
}

#: Forms that scanners mistake for secrets.
OTHER_FORMS: dict[str, Callable[[_Maker], tuple[str, str, str]]] = {
    "commit": lambda m: (m.chars(m.HEX, 40), m.prose(3) + m.pick("commit ", "revision ", "at commit: ", "git checkout "), "run"),
    "long digest": lambda m: (m.chars(m.HEX, 64, 128), m.prose(2) + m.pick("sha256:", "checksum ", "digest: sha256-", "SHA512 "), "run"),
    "short digest": lambda m: (m.chars(m.HEX, 32), m.prose(2) + m.pick("md5 ", "md5sum: ", "etag: ", "MD5="), "run"),
    "integrity": lambda m: (m.pick("sha384-", "sha512-") + m.chars(m.BASE64, 64, 86), m.prose(2) + m.pick('integrity="', "integrity: "), "run"),
    "uuid": lambda m: ("-".join(m.chars(m.HEX, k) for k in (8, 4, 4, 4, 12)), m.prose(3) + m.pick("", "uuid ", "id: ", "guid="), "run"),
    "phone": lambda m: (m.chars(string.digits, 3, 4) + "-" + m.chars(string.digits, 10, 14), m.prose(4), "run"),
    "order number": lambda m: (m.pick("SKU", "ORD", "INV", "REF") + "-" + m.chars(string.digits, 3, 5) + "-" + m.chars(string.ascii_uppercase, 2, 4) + "-" + m.chars(string.digits, 4, 6), m.prose(3) + m.pick("", "order ", "part no. "), "run"),
    "identifier": lambda m: (m.ident() + m.ident() + m.chars(string.digits, 2, 4), m.prose(4), "run"),
    "dotted name": lambda m: (m.ident() + "." + m.known() + "." + m.ident() + m.chars(string.digits, 2), m.prose(3) + m.pick("", "import ", "class "), "run"),
    "constant": lambda m: ("_".join(m.known().upper() for _ in range(3)) + "_" + m.chars(string.digits, 2, 4), m.prose(3), "run"),
    "path": lambda m: ("/".join(m.known() for _ in range(4)) + "/" + m.known() + "-" + m.chars(string.digits, 2) + "." + m.chars(string.digits, 2), m.prose(3) + m.pick("", "see ", "path ", "href=/"), "run"),
    "file name": lambda m: (m.pick("IMG_", "DSC", "scan-") + m.chars(string.digits, 8) + "_" + m.chars(string.digits, 6) + "." + m.pick("jpg", "png", "pdf"), m.prose(3), "run"),
    "placeholder": lambda m: (m.pick("your_api_key_here12", "xxxxxxxxxxxxxxxx00", "changeme", "example-token-123", "INSERT_TOKEN_HERE", "<password>", "placeholder123456", "test_password_1", "YOUR-SECRET-KEY", "dummy-value-1", "sample_secret_99"), m.named("api_key", "token", "password"), "assigned"),
    "hidden value": lambda m: (m.pick("*" * m.size(6, 16), "x" * m.size(6, 12), "." * m.size(6, 9), "[REDACTED]", "(hidden)", "[MASKED]"), m.named("password", "token", "secret"), "assigned"),
    "code": lambda m: (m.pick("os.environ", "getToken()", "${DB_PASSWORD}", "config.password", "process.env.TOKEN", "self.token", "request.token", "settings.SECRET_KEY", m.known() + ".get" + m.known().title() + "()", "$" + m.known().upper() + "_KEY", m.known() + "[" + m.known() + "]", "{{" + m.known() + "." + m.known() + "}}"), m.named("token", "password", "secret", "auth"), "assigned"),
    "plain words": lambda m: (m.pick(m.word() + m.word(), "required", "optional", "string", "expired", "invalid", "missing", "incorrect", "forgotten", "protected", "unknown"), m.named("token", "password", "auth", "secret"), "assigned"),
    "joined words": lambda m: (m.pick("-", "_", ".").join([m.known(), m.known(), m.known()]), m.named("token", "auth", "credentials"), "assigned"),
    "type": lambda m: (m.pick("Optional[str]", "String!", "varchar(255)", "string|null", "SecretStr", "Bearer", "OAuth2", "basic-auth", "HS256", "bcrypt"), m.named("token", "password", "auth", "secret"), "assigned"),
    "url placeholder": lambda m: (m.pick("password", "passwd", "pass", "$PASSWORD", "${PGPASSWORD}", "secret", "<password>", "****", "changeme", "[PASSWORD]", "{password}"), m.prose(2) + m.pick("postgres://user:", "mysql://root:", "https://user:", "ftp://name:"), "url"),
    "picture": lambda m: ("iVBORw0KGgo" + m.chars(m.BASE64, 60, 400), m.prose(1) + "src=data:image/png;base64,", "run"),
    "version": lambda m: ("v" + ".".join(m.chars(string.digits, 1, 3) for _ in range(3)) + "-" + m.known() + "." + m.chars(string.digits, 6, 8), m.prose(3) + m.pick("version ", "release "), "run"),
    "slug": lambda m: (m.known() + "." + m.chars(string.digits, 1, 2) + "-" + m.word() + "-" + m.known() + "-" + m.chars(string.digits, 2) + "-" + m.known(), m.prose(3), "run"),
    "moment": lambda m: (m.chars(string.digits, 4) + "-" + m.chars(string.digits, 2) + "-" + m.chars(string.digits, 2) + "T" + m.chars(string.digits, 6) + "Z", m.prose(3) + m.pick("", "at ", "build "), "run"),
    "address": lambda m: (m.word() + "." + m.word() + m.chars(string.digits, 2, 4) + "-" + m.known() + "." + m.pick("example.com", "example.org"), m.prose(3) + m.pick("", "mail ", "host "), "run"),
}


def labelled_findings(n: int = FINDINGS, seed: int = 23, without: str | None = None, only: str | None = None) -> list[Finding]:
    """A seeded set of labelled findings, half of them secrets, of all forms, of all but one, or of one alone."""
    m = _Maker(seed)
    forms = [[f for name, f in table.items() if name != without and only in (None, name)] for table in (OTHER_FORMS, SECRET_FORMS)]
    paths_for, paths_against = ("deploy/config.yml", ".env", "app/settings.py", "", "", "notes.txt"), ("docs/readme.md", "tests/test_app.py", "yarn.lock", "static/app.min.js", "", "", "notes.txt")
    out = []
    for i in range(n):
        good = i % 2 if forms[0] and forms[1] else int(bool(forms[1]))
        value, before, rule = m.pick(*forms[good])(m)
        after = "@" + m.word() + "/" + m.word() if rule == "url" else m.pick('"', "'", "", "") + " " + m.prose(4) if before[-1:] in "\"'" else m.pick(" ", "\n", ". ") + m.prose(4)
        out.append(Finding(value, before, after, m.pick(*(paths_for if good or m.rng.random() < 0.3 else paths_against)), rule, good))
    return out


def left_out_accuracy(n: int = 100, seed: int = 71) -> dict[str, float]:
    """Of each form, the share of new findings judged rightly by a forest that never saw the form."""
    out = {}
    for name in (*SECRET_FORMS, *OTHER_FORMS):
        found = labelled_findings(n, seed, only=name)
        right = (Detector(labelled_findings(without=name)).score(found) >= THRESHOLD) == np.array([f.is_secret for f in found])
        out[name] = float(right.mean())
    return out


def scan(docs: DataFrame, detector: Detector | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate: ``doc_id, start, end`` (code points), ``rule, length, fingerprint, score, is_secret``.

    The fingerprint is the value's SHA-256, so that findings can be compared
    without spreading the secrets.
    """
    detector = detector or Detector(labelled_findings())
    path = F.col(path_col).cast("string") if path_col else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), path.alias("path")).where("text is not null")
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "end": pa.int64(), "rule": pa.string(), "length": pa.int32(), "fingerprint": pa.string(), "score": pa.float64(), "is_secret": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc, text, where in zip(*(batch.column(i) for i in range(3)), strict=True):
                text = text.as_py()
                for a, b, rule, score in detector.scan(text, where.as_py()):
                    print_ = hashlib.sha256(text[a:b].encode()).hexdigest()
                    found.append((doc.as_py(), a, b, rule, b - a, print_, score, score >= threshold))
            columns = list(zip(*found, strict=True)) if found else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return rows.mapInArrow(trimmed(run), "doc_id long, start long, end long, rule string, length int, fingerprint string, score double, is_secret boolean")


def redact(docs: DataFrame, detector: Detector | None = None, path_col: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with every secret replaced by ``[SECRET]``; ``n_chars``, if there, follows the text."""
    detector = detector or Detector(labelled_findings())
    names = docs.columns
    text_at, path_at = names.index("text"), names.index(path_col) if path_col else None
    chars_at = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts, sizes = [], columns[chars_at].to_pylist() if chars_at is not None else []
            paths = columns[path_at] if path_at is not None else None
            for i, value in enumerate(columns[text_at]):
                text = value.as_py()
                spans = [(a, b) for a, b, _, s in detector.scan(text, str(paths[i].as_py() or "") if paths is not None else "") if s >= threshold]
                if spans:
                    parts, at = [], 0
                    for a, b in spans:
                        parts += [text[at:a], MASK]
                        at = b
                    text = "".join([*parts, text[at:]])
                    if chars_at is not None:
                        sizes[i] = len(text)
                texts.append(text)
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if chars_at is not None:
                columns[chars_at] = pa.array(sizes, columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(trimmed(run), docs.schema)
