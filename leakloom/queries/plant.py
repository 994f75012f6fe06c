"""Texts with token-shaped values, derived from ids in the same way for Spark and for SQL.

Only prefixes stand here; the rest of each value comes from an id, so no file of this repository holds a token-shaped literal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import bound

BEFORE = (" ", '"', "é", "\n", "=", "`", "\t")
AFTER = ("", " ", '"', ";", "é", "\n", ".", "\\n", "x")


class Part:
    """A piece of a token: hex digits of the id's SHA-256, repeated as often as needed."""

    def __init__(self, start: int, n: int, upper: bool = False):
        self.start, self.n, self.upper = start, n, upper

    def spark(self, digits: Column) -> Column:
        h = F.substring(digits, self.start, self.n)
        return F.upper(h) if self.upper else h

    def sql(self, key: str) -> str:
        h = f"substr(repeat(sha256({key}::VARCHAR), 4), {self.start}, {self.n})"
        return f"upper({h})" if self.upper else h


class Letters(Part):
    """The same digits as letters a to p."""

    def spark(self, digits: Column) -> Column:
        return F.translate(super().spark(digits), "0123456789abcdef", "ghijklmnopabcdef")

    def sql(self, key: str) -> str:
        return f"translate({super().sql(key)}, '0123456789abcdef', 'ghijklmnopabcdef')"


Token = tuple  # of texts and parts


def _digits(key: Column) -> Column:
    return F.repeat(F.sha2(key.cast("string"), 256), 4)


def _token(token: Token, digits: Column) -> Column:
    return F.concat(*(p.spark(digits) if isinstance(p, Part) else F.lit(p) for p in token))


def spark_token(token: Token, key: Column) -> Column:
    return _token(token, _digits(key))


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_token(token: Token, key: str) -> str:
    return " || ".join(p.sql(key) if isinstance(p, Part) else quote(p) for p in token)


def spark_text(tokens: tuple[Token, ...], key: str = "doc_id", text: str = "text") -> Column:
    """A row's own text, then each token between neighbours that vary with the id. The id's hash is worked out once for all of them."""
    k = F.col(key)
    pick = lambda options, step: F.element_at(F.array(*map(F.lit, options)), ((k + step) % len(options) + 1).cast("int"))

    def planted(digits: Column) -> Column:
        return F.concat(*(x for i, t in enumerate(tokens) for x in (pick(BEFORE, i), _token(t, digits), pick(AFTER, 3 * i))))

    return F.concat(F.coalesce(F.col(text), F.lit("")), bound(_digits(k), planted))


def sql_text(tokens: tuple[Token, ...], key: str = "doc_id", text: str = "text") -> str:
    pick = lambda options, step: f"([{', '.join(map(quote, options))}])[({key} + {step}) % {len(options)} + 1]"
    return f"coalesce({text}, '')" + "".join(f" || {pick(BEFORE, i)} || {sql_token(t, key)} || {pick(AFTER, 3 * i)}" for i, t in enumerate(tokens))


#: Tokens by detector.
TOKENS: dict[str, tuple[Token, ...]] = {
    "github-pat": (("ghp_", Part(1, 36)), ("gho_", Part(2, 36)), ("ghu_", Part(3, 40)), ("ghs_", Part(4, 36)), ("ghr_", Part(5, 36)), ("github_pat_", Part(1, 82)), ("ghp_", Part(6, 35), "-")),
    "npm-token": (("npm_", Part(1, 36)), ("NPM_", Part(2, 36, True)), ("npm_", Part(1, 36)), ("npm_", Part(3, 37))),
    "ssh-private-key": (("-----BEGIN RSA PRIVATE KEY-----\n", Part(1, 64), "\n", Part(5, 64), "\n-----END RSA PRIVATE KEY-----"), ("-----BEGIN PRIVATE KEY-----\nDEK-Info: x\n", Part(1, 90), "\n-----END PRIVATE KEY-----"), ("-----BEGIN OPENSSH PRIVATE KEY-----\n", Part(3, 70), "YWVzMjU2LWN0cg", "\n-----END OPENSSH PRIVATE KEY-----")),
    "ai-service": (("sk-proj-", Part(1, 74), "T3BlbkFJ", Part(2, 74)), ("sk-", Part(1, 20), "T3BlbkFJ", Part(2, 20)), ("sk-ant-api03-", Part(1, 93), "AA"), ("sk-ant-admin01-", Part(2, 93), "AA"), ("hf_", Letters(1, 34)), ("api_org_", Letters(3, 34))),
    "http-auth": (("Authorization: Bearer ", Part(1, 40)), ("authorization: Basic ", Part(2, 30), "=="), ("X-API-Key: ", Part(3, 24)), ("https://user", Part(1, 4), ":", Part(5, 12), "@example.org/x"), ("Authorization: Token ", Part(7, 15))),
    "cloud-credentials": (("AKIA", Part(1, 16, True)), ("ASIA", Part(2, 16, True)), ("AIza", Part(3, 35)), ("AccountKey=", Part(1, 86), "==")),
    "vault-token": (("hvs.", Part(1, 24)), ("s", ".", Part(2, 30)), ("hvs.", Part(1, 24)), ("hvs.", Part(1, 23))),
    "pypi-token": (("pypi-", Part(1, 20)), ("pypi-", Part(2, 16), "-_", Part(3, 4)), ("pypi-", Part(1, 15))),
    "wireguard-key": (("PrivateKey = ", Part(1, 43), "="), ("PrivateKey=", Part(2, 43), "="), ("PrivateKey  =\t", Part(3, 42), "=")),
    "splunk-token": (("splunkd_", Part(1, 32)), ("splunkd_", Part(2, 40)), ("splunkd_", Part(2, 31))),
    "database-connection": (("postgres://app:", Part(1, 12), "@db.example.org:5432/x"), ("MYSQL://:", Part(2, 10), "@h"), ("mongodb+srv://u", Part(3, 3), ":", Part(4, 9), "@c0.example.net/?a=1"), ("redis://", "nobody@host/0")),
    "slack-token": (("xoxb-", Part(1, 20)), ("xoxp-", Part(2, 12), "-", Part(3, 8)), ("xapp-", Part(4, 24)), ("xoxs-", Part(5, 9))),
    "stripe-key": (("sk_live_", Part(1, 24)), ("sk_test_", Part(2, 30)), ("rk_live_", Part(3, 24)), ("pk_test_", Part(4, 24)), ("sk_live_", Part(1, 24))),
    "twilio-key": (("SK", Part(1, 32)), ("SK", Part(2, 32, True)), ("SK", Part(3, 33))),
    "generic-api-key": (("api_key = '", Part(1, 32), "'"), ("SECRET: ", Part(2, 20)), ("password=", "your-", Part(3, 12)), ("token := aaaaaaaaaaaa",)),
}
