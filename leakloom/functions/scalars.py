"""Column functions on single values. All are Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regexport import CI, S


def bound(value: Column, body) -> Column:
    """body of a value that is worked out once for each row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Bytes of a text up to which each of its distinct characters may have a look at it.
SHORT = 256


def shannon_entropy(text: Column) -> Column:
    """Bits per character, where a character's share is its count over the text's bytes; 0 for an empty text."""

    n = F.octet_length(text).cast("double")

    def term(count: Column) -> Column:
        share = count / n
        return share * F.log2(share)

    def total(terms: Column) -> Column:
        return F.aggregate(terms, F.lit(0.0), lambda a, b: a - b)

    def of_short(chars: Column) -> Column:
        """What a text loses without each character: no sort, but a look at it for each distinct one."""
        return total(F.transform(F.array_distinct(chars), lambda c: term((n - F.octet_length(F.replace(text, c, F.lit("")))) / F.octet_length(c))))

    def of(chars: Column) -> Column:
        # Runs of equal characters of the sorted text: one pass, whatever the number of distinct ones.
        runs = F.regexp_extract_all(F.array_join(F.sort_array(chars), ""), F.lit(r"(?s)(.)\1*+"), F.lit(0))
        counts = bound(runs, lambda r: F.map_from_arrays(F.transform(r, lambda x: F.left(x, F.lit(1))), F.transform(r, F.length)))
        # In the order of the characters' first places, as a sum of doubles hangs on it.
        terms = bound(counts, lambda m: F.transform(F.array_distinct(chars), lambda c: term(m[c])))
        return total(terms)

    whole = bound(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), of)
    return F.when(F.length(text) == 0, F.lit(0.0)).when(F.octet_length(text) <= SHORT, bound(F.split(text, ""), of_short)).otherwise(whole)


def entropy_text(entropy: Column) -> Column:
    """Two decimals, halves to even."""
    return F.format_number(F.bround(entropy, 2), 2)


#: Words of placeholders and of what they stand for.
PLACEHOLDER_WORDS = ("your", "my", "the", "example", "sample", "test", "demo", "placeholder", "change", "replace", "insert", "put")
CREDENTIAL_WORDS = ("key", "token", "secret", "password", "api", "auth")
LITERALS = ("true", "false", "null", "none", "undefined", "localhost", r"127\.0\.0\.1")


def is_placeholder(value: Column) -> Column:
    """Whether a value stands for a secret, or is too short to be one."""
    trimmed = F.trim(value, F.lit("\t\n\f\r "))
    words = "|".join(PLACEHOLDER_WORDS)
    rules = (
        f"{CI}^(?:{words})[-_]", f"{CI}(?:{words})[-_](?:{'|'.join(CREDENTIAL_WORDS)})", f"{CI}^(?:xxx|yyy|zzz|abc|123)", f"{CI}^x{{5,}}\\z", r"^\*{5,}\z", r"^\.{3,}\z",
        r"^\$\{?[A-Z_]+\}?\z", f"{CI}^(?:{'|'.join(LITERALS)})\\z",
    )
    return bound(trimmed, lambda t: (F.octet_length(t) < 10) | t.rlike("|".join(f"(?:{r})" for r in rules)))


def key_type(pem: Column) -> Column:
    named = F.upper(F.regexp_extract(pem, f"{CI}-----BEGIN{S}+([A-Z0-9_-]+){S}+PRIVATE KEY", 1))
    return F.when(named != "", named).when(F.upper(pem).contains("BEGIN PRIVATE KEY"), "PKCS8").otherwise("UNKNOWN")


#: base64 of cipher and key-derivation names within encrypted OpenSSH keys.
ENCRYPTED_MARKS = ("YWVzMTI4LWN0cg", "YWVzMTkyLWN0cg", "YWVzMjU2LWN0cg", "YWVzMTI4LWNiYw", "YWVzMTkyLWNiYw", "YWVzMjU2LWNiYw", "YmNyeXB0")


def is_encrypted(pem: Column) -> Column:
    hit = F.upper(pem).contains("ENCRYPTED") | pem.contains("DEK-Info:")
    for mark in ENCRYPTED_MARKS:
        hit = hit | pem.contains(mark)
    return hit


def key_title(kind: Column) -> Column:
    names = F.when(kind.isin("RSA", "DSA", "EC", "PKCS8"), F.concat(kind, F.lit(" SSH "))).when(kind == "OPENSSH", "OpenSSH ").otherwise("SSH ")
    return F.concat(names, F.lit("Private Key Detected"))


_TEXT_CLAIMS = ("iss", "sub", "repository", "workflow", "ref", "actor", "tid", "appid")
CLAIMS = "struct<iss string, sub string, aud string, exp string, iat string, namespace string, serviceaccount string, k8s boolean, repository string, workflow string, ref string, actor string, tid string, appid string>"


def jwt_claims(token: Column) -> Column:
    """Claims of a three-part token, or null: if the payload is no base64 or JSON object, or a claim that is read has another type."""
    parts = F.split(token, r"\.")
    raw = F.translate(F.get(parts, 1), "-_", "+/")

    def of_json(text: Column) -> Column:
        value = F.try_parse_json(text)
        kind = lambda path: F.schema_of_variant(F.try_variant_get(value, path, "variant"))
        get = lambda path: F.try_variant_get(value, path, "string")
        textual = lambda path: F.coalesce(kind(path), F.lit("VOID")).isin("STRING", "VOID")
        object_like = lambda path: F.coalesce(kind(path), F.lit("VOID")).rlike("^(OBJECT|VOID)")
        number = lambda path: F.coalesce(kind(path), F.lit("VOID")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|VOID)") | (F.coalesce(kind(path), F.lit("VOID")) == "STRING") & get(path).rlike(r"^(-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?)?\z")
        sound = F.schema_of_variant(value).startswith("OBJECT")
        for name in _TEXT_CLAIMS:
            sound = sound & textual(f"$.{name}")
        sound = sound & number("$.exp") & number("$.iat") & object_like("$['kubernetes.io']") & textual("$['kubernetes.io'].namespace") & object_like("$['kubernetes.io'].serviceaccount") & textual("$['kubernetes.io'].serviceaccount.name")
        named = {n: get(f"$.{n}") for n in _TEXT_CLAIMS}
        aud = F.when(F.coalesce(kind("$.aud"), F.lit("")) == "STRING", F.to_json(F.array(get("$.aud")))).when(F.coalesce(kind("$.aud"), F.lit("")).rlike(r"^ARRAY<(STRING|VOID)>"), get("$.aud"))
        fields = {
            "iss": named["iss"], "sub": named["sub"], "aud": aud, "exp": get("$.exp"), "iat": get("$.iat"), "namespace": get("$['kubernetes.io'].namespace"), "serviceaccount": get("$['kubernetes.io'].serviceaccount.name"),
            "k8s": F.coalesce(kind("$['kubernetes.io']"), F.lit("VOID")).startswith("OBJECT"), **{n: named[n] for n in _TEXT_CLAIMS[2:]},
        }
        return F.when(sound, F.struct(*(c.alias(n) for n, c in fields.items())))

    decoded = F.try_to_binary(raw, F.lit("base64"))
    # What can't be an object isn't parsed: a parser's errors cost more than all else here.
    claims = bound(F.make_valid_utf8(decoded.cast("string")), lambda x: F.when(x.rlike(r"(?s)^[\x00-\x20\uFEFF]*\{.*\}"), of_json(x)))
    return F.when(F.size(parts) == 3, claims).cast(CLAIMS)


def _aud(claims: Column) -> Column:
    return F.from_json(claims["aud"], "array<string>")


def jwt_subtype(claims: Column) -> Column:
    """Who issued the token, by the first rule that holds; null if none does."""
    text = lambda name: F.coalesce(claims[name], F.lit(""))
    iss = text("iss")
    return (
        F.when(claims.isNull(), F.lit(None).cast("string"))
        .when(F.coalesce(claims["k8s"], F.lit(False)) | text("sub").startswith("system:serviceaccount:") | (iss == "kubernetes/serviceaccount"), "jwt-kubernetes-service-account")
        .when(iss == "https://token.actions.githubusercontent.com", "jwt-github-actions-oidc")
        .when(iss.rlike(r"^https://oidc\.eks\.[a-z0-9-]+\.amazonaws\.com/"), "jwt-aws-irsa")
        .when(iss.startswith("https://sts.windows.net/") | iss.startswith("https://login.microsoftonline.com/"), "jwt-azure-ad")
        .when(iss.isin("https://accounts.google.com", "accounts.google.com"), "jwt-gcp-id-token")
        .when(iss.endswith(".iam.gserviceaccount.com"), "jwt-gcp-service-account")
        .when(F.exists(F.coalesce(_aud(claims), F.array().cast("array<string>")), lambda a: F.lower(a).contains("vault")), "jwt-vault-auth")
    )


def _entries(*pairs: tuple[str, Column]) -> Column:
    """A map of the pairs whose value is neither null nor empty."""
    rows = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs))
    return F.map_from_entries(F.filter(rows, lambda r: r["value"].isNotNull() & (r["value"] != "")))


def jwt_standard(claims: Column, now: Column) -> Column:
    """Registered claims as text; exp and iat are truncated, expired tells whether exp has passed at now (in seconds)."""
    whole = lambda c: F.coalesce(c.try_cast("bigint"), c.try_cast("double").cast("bigint"))
    exp, iat = whole(claims["exp"]), whole(claims["iat"])
    aud = F.when(F.size(_aud(claims)) > 0, claims["aud"])
    return _entries(("iss", claims["iss"]), ("sub", claims["sub"]), ("aud", aud), ("exp", exp), ("expired", (now >= exp)), ("iat", iat))


def jwt_extras(claims: Column, subtype: Column) -> Column:
    """What each kind of token says besides."""
    only = lambda kind, name: F.when(subtype == kind, claims[name])
    return _entries(
        ("k8s_namespace", only("jwt-kubernetes-service-account", "namespace")), ("k8s_serviceaccount", only("jwt-kubernetes-service-account", "serviceaccount")),
        ("github_repository", only("jwt-github-actions-oidc", "repository")), ("github_workflow", only("jwt-github-actions-oidc", "workflow")), ("github_ref", only("jwt-github-actions-oidc", "ref")), ("github_actor", only("jwt-github-actions-oidc", "actor")),
        ("oidc_issuer", only("jwt-aws-irsa", "iss")), ("azure_tenant", only("jwt-azure-ad", "tid")), ("azure_app_id", only("jwt-azure-ad", "appid")), ("gcp_service_account", only("jwt-gcp-service-account", "iss")),
    )


def is_null_device(value: Column) -> Column:
    return F.lower(value).contains("/dev/null") | (F.lower(F.regexp_extract(value, r"([^/\\]*)\z", 1)) == "nul")


def mask_token(token: Column) -> Column:
    """The first eight bytes and the length in bytes."""
    """The first eight bytes and the length in bytes."""
    head = F.make_valid_utf8(F.substring(token.cast("binary"), 1, 8).cast("string"))
    return F.concat(head, F.lit("…("), F.octet_length(token).cast("string"), F.lit(")"))


def format_source(source: Column, line: Column) -> Column:
    return F.when(line > 0, F.concat(source, F.lit(":"), line.cast("string"))).otherwise(source)


def type_name(kind: Column) -> Column:
    return F.when(kind == "secret", "Secret").when(kind == "misconfiguration", "Misconfiguration").otherwise(kind)


def value_line(value: Column, document: Column) -> Column:
    """The line, from 1, where a value first stands in a document; 0 if nowhere, empty, or if it holds a character that XML escapes."""
    at = F.instr(document, value)
    line = F.length(F.regexp_replace(F.left(document, at - 1), "[^\n]", "")) + 1
    return F.when((value == "") | value.rlike("[&<>\"']") | (at == 0), F.lit(0)).otherwise(line).cast("int")


def unescape_fish(command: Column) -> Column:
    """Backslash escapes of a fish history, in one pass: n, r and t are control characters, any other stands for itself, a last backslash stays."""
    protected = F.replace(command, F.lit("\\\\"), F.lit("\x00"))
    for letter, sign in (("n", "\n"), ("r", "\r"), ("t", "\t")):
        protected = F.replace(protected, F.lit("\\" + letter), F.lit(sign))
    return F.replace(F.regexp_replace(protected, r"(?s)\\(.)", "$1"), F.lit("\x00"), F.lit("\\"))


def plain_fingerprint(value: Column) -> Column:
    return F.sha2(value, 256)


def fields_fingerprint(*fields: Column) -> Column:
    """SHA-256 of the fields as a compact JSON array, with HTML signs and line separators escaped."""
    text = F.to_json(F.array(*fields))
    for sign in ("<", ">", "&", " ", " "):
        text = F.replace(text, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
    return F.sha2(text, 256)


def host_salt(os: Column, arch: Column, hostname: Column, username: Column) -> Column:
    return F.concat(os, F.lit(":"), arch, F.lit(":"), hostname, F.lit(":"), username)


def hmac_pads(salt: Column) -> Column:
    """The two hex key blocks of HMAC-SHA256, to be worked out once for each host."""
    key = F.when(F.octet_length(salt) > 64, F.unhex(F.sha2(salt, 256))).otherwise(F.encode(salt, "UTF-8"))
    digits = F.rpad(F.hex(key), 128, "0")

    def xor(byte: int) -> Column:
        # One hex digit at a time, by translation.
        high, low = byte >> 4, byte & 15
        signs = "0123456789ABCDEF"
        mapped = lambda nibble: "".join(signs[i ^ nibble] for i in range(16))
        pairs = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.concat(F.translate(F.substring(digits, 2 * i + 1, F.lit(1)), signs, mapped(high)), F.translate(F.substring(digits, 2 * i + 2, F.lit(1)), signs, mapped(low))))
        return F.array_join(pairs, "")

    return F.struct(xor(0x36).alias("inner"), xor(0x5C).alias("outer"))


def hmac_hex(pads: Column, value: Column) -> Column:
    inner = F.sha2(F.concat(F.unhex(pads["inner"]), F.encode(value, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(pads["outer"]), F.unhex(inner)), 256)
