"""Queries of file selection, text preparation, configuration rules and nested documents, over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.rows import spread
from ..operators import configs, files as fs, findings as fd, nested, text as tx
from .detection import documents
from .plant import quote

NOW = "2024-06-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths by doc_id; {i} is the id.
PATHS = (
    ".aws/config", "work/{i}/.aws/config", "x.aws/config", ".ssh/id_{i}", ".ssh/deep/id_{i}", ".env", "app/.env.{i}", "node_modules/p/.env", ".claude/projects/p{i}/s.jsonl", ".cache/a/.env", "go/pkg/mod/x/.npmrc", ".npmrc", "a/b/c/d/e/.gitconfig", "notes/{i}.txt",
    ".codex/sessions/2024/01/02/rollout-{i}.jsonl", "t/prod.auto.tfvars", ".bash_history", ".local/share/fish/fish_history", "src/CLAUDE.md", ".docker/contexts/tls/a/b/key.pem", ".kube/config", ".sfdx/auth/{i}.json", "config/database.yml", ".aws/sso/cache/{i}.json",
)


def _path(key: str = "doc_id"):
    return F.replace(F.element_at(F.array(*map(F.lit, PATHS)), (F.col(key) % len(PATHS) + 1).cast("int")), F.lit("{i}"), F.col(key).cast("string"))


_PATH = f"replace(([{', '.join(map(quote, PATHS))}])[doc_id % {len(PATHS)} + 1], '{{i}}', doc_id::VARCHAR)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.col("source").alias("host_id"), _path().alias("path"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))


_FILES = f"f AS (SELECT doc_id, source AS host_id, {_PATH} AS path, coalesce(strlen(text), 0)::BIGINT AS size FROM documents)"



def _catalogue_sql() -> str:
    """The catalogue as rows, each glob as an RE2 pattern or a suffix, written from its text alone."""
    from ..operators.catalogue import PATTERNS

    rows = []
    for i, (name, globs, _) in enumerate(PATTERNS):
        for g in globs:
            wild = "*" in g or "?" in g
            rx = g.replace(".", "[.]").replace("*", "[^/]*").replace("?", "[^/]")
            kind = "suffix" if "/" in g and not wild else "tail" if "/" in g else "base"
            rows.append(f"({i}, {quote(name)}, '{kind}', {quote(g if kind == 'suffix' else ('(?:^|/)' if kind == 'tail' else '^') + rx + '$')})")
    return f"p AS (SELECT * FROM (VALUES {', '.join(rows)}) AS v(ord, pattern_name, kind, rx))"


_KEPT = "k AS (SELECT * FROM f WHERE NOT list_has_any(string_split(path, '/')[:-2], ['node_modules', '__pycache__', '.tox']) AND NOT regexp_matches(path, '^([.]cache|go/pkg/mod|[.]gradle/caches|[.]m2/repository|[.]npm/_cacache|[.]Trash|Library/Caches|Library/Logs)(/|$)'))"
_TAGGED = f"{_FILES}, {_KEPT}, {_catalogue_sql()}, tags AS (SELECT DISTINCT k.*, pattern_name FROM k JOIN p ON CASE kind WHEN 'suffix' THEN ends_with(path, rx) WHEN 'tail' THEN regexp_matches(path, rx) ELSE regexp_matches(string_split(path, '/')[-1], rx) END)"


def tag_files(spark, sf_dir):
    return fs.tag_files(files(spark, sf_dir)).select("doc_id", "pattern_name")


def max_depth(spark, sf_dir):
    return fs.max_depth_filter(files(spark, sf_dir), 2).select("doc_id", "path")


def index_counts(spark, sf_dir):
    return fs.index_counts(fs.tag_files(files(spark, sf_dir)))


def route_probes(spark, sf_dir):
    routed = fs.route_probes(fs.tag_files(files(spark, sf_dir)), fs.routes_table(spark), ("cloud", "env", "ai_chats", "shell_history", "git"))
    return fs.cap_size(fs.dedup_paths(routed.drop("size_cap")), {"ai_chats": 1 << 20, "env": 0}).select("host_id", "path", "probe", "pattern_name")


def expand_base_dirs(spark, sf_dir):
    rows = files(spark, sf_dir).withColumn("path", F.concat(F.lit("/home/u/"), "path"))
    return fs.expand_base_dirs(rows, ["~", "$HOME/work", "/home/u/.ssh"], "/home/u").select("doc_id", "base_dir", "rel_path")


def exact_match(spark, sf_dir):
    return files(spark, sf_dir).where(fs.matches(F.col("path"), ".env", "exact") | fs.matches(F.col("path"), "src/CLAUDE.md", "exact")).select("doc_id", "path")


def drop_expired(spark, sf_dir):
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kind = F.col("event_id") % 4
    doc = F.when(kind == 0, F.concat(F.lit('{"expiresAt":"'), ts, F.lit('"}'))).when(kind == 1, F.concat(F.lit('{"expiresAt":"2099-01-01T00:00:00Z","Credentials":{"Expiration":"'), ts, F.lit('"}}'))).when(kind == 2, '{"expiresAt":"soon"}').otherwise("no json")
    return fs.drop_expired_cache(table(spark, sf_dir, "events").select("event_id", doc.alias("content")), F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id")


def grace(spark, sf_dir):
    return fs.grace_filter(table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("mtime")), 90, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id")


def changed_since(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("host_id"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").alias("mtime"), F.floor("o_totalprice").cast("long").alias("size"))
    k = F.col("path").cast("long")
    return fs.changed_since(o.where(k % 7 != 1), o.where(k % 5 != 2).withColumn("size", F.when(k % 3 == 0, F.col("size") + 1).otherwise(F.col("size"))))


def even_sample(spark, sf_dir):
    return fs.even_sample(files(spark, sf_dir).withColumn("path", F.concat("path", F.lit("#"), F.format_string("%09d", "doc_id"))), 7).select("host_id", "path")


_LINES = "l0 AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents), l1 AS (SELECT doc_id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM l0), l AS (SELECT doc_id, unnest(range(1, len(a) + 1))::INT AS line_number, unnest(list_transform(a, lambda x: regexp_replace(x, '\\r$', ''))) AS line FROM l1)"


def lines(spark, sf_dir):
    return tx.to_lines(documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("content"))).select("doc_id", "line_number", sc.plain_fingerprint(F.col("line")).alias("line_hash"))


def _history(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    kind = (F.col("conv_id") + F.col("turn")) % 5
    first = F.regexp_replace("text", "[\n\r]", " ")
    line = F.when(kind == 0, F.concat(F.lit(": 1700000000:0;"), first)).when(kind == 1, F.concat(F.lit("- cmd: "), first, F.lit("\\n\\\\x\\t end\\"))).when(kind == 2, "  when: 17").when(kind == 3, F.concat(F.lit("\tcmd:"), first)).otherwise(first)
    return c.select("conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, ".local/share/fish/fish_history").otherwise(".zsh_history").alias("path"), line.alias("line"))


def history(spark, sf_dir):
    return tx.parse_history(_history(spark, sf_dir)).select("conv_id", "turn", "line")


_HISTORY = r"""WITH h AS (SELECT conv_id, turn, conv_id % 2 = 0 AS fish, (conv_id + turn) % 5 AS kind, regexp_replace(text, '[\n\r]', ' ', 'g') AS f FROM conversations),
g AS (SELECT *, CASE kind WHEN 0 THEN ': 1700000000:0;' || f WHEN 1 THEN '- cmd: ' || f || '\n\\x\t end\' WHEN 2 THEN '  when: 17' WHEN 3 THEN chr(9) || 'cmd:' || f ELSE f END AS raw FROM h),
z AS (SELECT *, CASE WHEN starts_with(raw, ':') AND contains(raw, ';') THEN substr(raw, instr(raw, ';') + 1) ELSE raw END AS p FROM g),
c AS (SELECT conv_id, turn, CASE WHEN fish THEN regexp_extract(p, '^[ \t]*(?:- )?cmd:[ \t]*((?s:.*))$', 1) ELSE p END AS x, fish FROM z WHERE NOT fish OR regexp_matches(p, '^[ \t]*(?:- )?cmd:'))
SELECT conv_id, turn, CASE WHEN fish THEN replace(regexp_replace(replace(replace(replace(replace(x, '\\', chr(1)), '\n', chr(10)), '\r', chr(13)), '\t', chr(9)), '(?s)\\(.)', '\1', 'g'), chr(1), '\') ELSE x END AS line FROM c WHERE trim(x, chr(32) || chr(9) || chr(10) || chr(13)) <> ''"""

#: Settings by order key: (tool, text of the configuration). {k} is the key, {u} an account balance of its customer.
SETTINGS = (
    ("git", "http.sslverify=FALSE\ncore.sshcommand=ssh -o StrictHostKeyChecking=no -o UserKnownHostsFile=/dev/null\ncredential.helper=store --file x{k}\nhttp.sslverify=false"),
    ("git", "protocol.ext.allow=always\nfetch.fsckobjects=false\nhttp.proxy=http://p{k}\ncore.hookspath=/h\nno equals\n user.name = a b "),
    ("git", "core.sshcommand=ssh -o userknownhostsfile NUL\ncredential.helper=cache store\nhttp.sslverify=true\ncore.sshcommand=ssh"),
    ("npm", "; c\nstrict-ssl=false\nregistry=http://r{k}/\n@a:registry = \"https://x\"\nalways-auth: TRUE\n"),
    ("pypirc", "[pypi]\nRepository = http://p{k}\npassword=\n=x\n# c\nuser: z"),
    ("pip", "[global]\nindex-url = https://u:p@h{k}/simple\nextra-index-url=http://h\n"),
)


def _config_files(spark, sf_dir):
    k = F.col("o_orderkey")
    pick = lambda i: F.element_at(F.array(*(F.lit(s[i]) for s in SETTINGS)), (k % len(SETTINGS) + 1).cast("int"))
    return spread(table(spark, sf_dir, "orders")).select(F.concat(F.lit("/c/"), k.cast("string")).alias("path"), pick(0).alias("tool"), F.replace(pick(1), F.lit("{k}"), k.cast("string")).alias("content"))


def _settings(spark, sf_dir):
    rows = _config_files(spark, sf_dir)
    return fd.union_findings(tx.parse_git_config(rows.where("tool = 'git'")), tx.parse_npmrc(rows.where("tool = 'npm'")), tx.parse_ini(rows.where("tool IN ('pypirc', 'pip')")))


def parse_configs(spark, sf_dir):
    return _settings(spark, sf_dir).select("path", "key", "value", "line_number")


def config_rules(spark, sf_dir):
    return configs.apply_config_rules(_settings(spark, sf_dir)).select("path", "finding_id", "severity", "key", "fingerprint")


_CONFIG = f"""o AS (SELECT '/c/' || o_orderkey AS path, ([{', '.join(quote(t) for t, _ in SETTINGS)}])[o_orderkey % {len(SETTINGS)} + 1] AS tool, replace(([{', '.join(quote(c) for _, c in SETTINGS)}])[o_orderkey % {len(SETTINGS)} + 1], '{{k}}', o_orderkey::VARCHAR) AS content FROM orders),
cl AS (SELECT path, tool, unnest(range(1, len(string_split(content, chr(10))) + 1))::INT AS n, trim(unnest(string_split(content, chr(10)))) AS x FROM o),
cs AS (SELECT *, CASE WHEN contains(x, '=') THEN instr(x, '=') WHEN tool = 'npm' THEN instr(x, ':') ELSE 0 END AS p FROM cl WHERE x <> '' AND NOT (tool = 'npm' AND x[1] IN ('#', ';')) AND NOT (tool IN ('pip', 'pypirc') AND x[1] IN ('#', ';', '['))),
ckv AS (SELECT path, tool, n AS line_number, CASE tool WHEN 'git' THEN left(x, p - 1) WHEN 'npm' THEN trim(left(x, p - 1)) ELSE lower(trim(left(x, p - 1))) END AS key, CASE tool WHEN 'git' THEN substr(x, p + 1) WHEN 'npm' THEN trim(trim(substr(x, p + 1)), '"''') ELSE trim(substr(x, p + 1)) END AS value FROM cs WHERE p > CASE WHEN tool IN ('pip', 'pypirc') THEN 1 ELSE 0 END),
kv AS (SELECT * FROM ckv QUALIFY row_number() OVER (PARTITION BY path, key ORDER BY line_number DESC) = 1)"""

_RULES = """r AS (
SELECT *, 'git-ssl-verify-disabled' AS finding_id, 'high' AS severity FROM kv WHERE tool = 'git' AND key = 'http.sslverify' AND lower(value) = 'false'
UNION ALL SELECT *, 'git-ssh-no-host-key-check', 'high' FROM kv WHERE tool = 'git' AND key = 'core.sshcommand' AND regexp_matches(lower(value), 'stricthostkeychecking[= ]no')
UNION ALL SELECT *, 'git-ssh-no-known-hosts', 'high' FROM kv WHERE tool = 'git' AND key = 'core.sshcommand' AND regexp_matches(lower(value), 'userknownhostsfile(=| +)(\\S*/dev/null|nul( |$))')
UNION ALL SELECT *, 'git-credential-plaintext', 'high' FROM kv WHERE tool = 'git' AND key = 'credential.helper' AND contains(lower(value), 'store') AND NOT contains(lower(value), 'cache')
UNION ALL SELECT *, 'git-dangerous-protocol', 'medium' FROM kv WHERE tool = 'git' AND regexp_matches(key, '^protocol[.](ext|fd|file)[.]allow$') AND lower(value) = 'always'
UNION ALL SELECT *, 'git-fsck-disabled', 'medium' FROM kv WHERE tool = 'git' AND regexp_matches(key, '^(transfer|fetch|receive)[.]fsckobjects$') AND lower(value) = 'false'
UNION ALL SELECT *, 'git-proxy-configured', 'low' FROM kv WHERE tool = 'git' AND key IN ('http.proxy', 'https.proxy', 'core.gitproxy') AND value <> ''
UNION ALL SELECT *, 'git-custom-hooks-path', 'medium' FROM kv WHERE tool = 'git' AND key = 'core.hookspath' AND value <> ''
UNION ALL SELECT *, 'npm-ssl-verify-disabled', 'high' FROM kv WHERE tool = 'npm' AND key = 'strict-ssl' AND lower(value) = 'false'
UNION ALL SELECT *, 'npm-insecure-registry', 'high' FROM kv WHERE tool = 'npm' AND contains(key, 'registry') AND starts_with(value, 'http://')
UNION ALL SELECT *, 'npm-always-auth-enabled', 'low' FROM kv WHERE tool = 'npm' AND key = 'always-auth' AND lower(value) = 'true'
UNION ALL SELECT *, 'pypi-plaintext-password', 'high' FROM kv WHERE tool = 'pypirc' AND key = 'password'
UNION ALL SELECT *, 'pypi-insecure-repository', 'high' FROM kv WHERE tool = 'pypirc' AND key = 'repository' AND starts_with(value, 'http://')
UNION ALL SELECT *, 'pip-index-embedded-credentials', 'high' FROM kv WHERE tool = 'pip' AND key IN ('index-url', 'extra-index-url') AND starts_with(value, 'http') AND contains(value, '@'))
SELECT path, finding_id, severity, key, sha256('["' || finding_id || '","' || CASE WHEN tool = 'git' THEN 'git-config:' || key ELSE path END || '"' || CASE WHEN finding_id IN ('npm-insecure-registry', 'pip-index-embedded-credentials') THEN ',"' || key || '"' WHEN finding_id = 'pypi-insecure-repository' THEN ',"' || value || '"' ELSE '' END || ']') AS fingerprint FROM r"""

SSH = "# c\nForwardAgent yes\nHost a{k} b\n  StrictHostKeyChecking no\n  stricthostkeychecking NO\nUserKnownHostsFile /dev/null\nHost *\nforwardagent YES\nUserKnownHostsFile nul\nHost"


def ssh_rules(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "customer")).select(F.concat(F.lit("/s/"), F.col("c_custkey").cast("string")).alias("path"), F.replace(F.lit(SSH), F.lit("{k}"), F.col("c_custkey").cast("string")).alias("content"))
    return configs.ssh_config_rules(rows).select("path", "host", "finding_id", "severity", "line_number", "for_all_hosts", "fingerprint")


_SSH = """WITH c AS (SELECT '/s/' || c_custkey AS path, c_custkey AS k FROM customer),
r AS (SELECT path, 'a' || k || ' b' AS host, 'ssh-strict-host-key-checking-disabled' AS finding_id, 'high' AS severity, 4 AS line_number FROM c UNION ALL SELECT path, 'a' || k || ' b', 'ssh-known-hosts-disabled', 'high', 6 FROM c
UNION ALL SELECT path, '*', 'ssh-forward-agent-enabled', 'medium', 2 FROM c UNION ALL SELECT path, '*', 'ssh-known-hosts-disabled', 'high', 9 FROM c)
SELECT *, host = '*' AND finding_id = 'ssh-forward-agent-enabled' AS for_all_hosts, sha256('["' || finding_id || '","' || path || '","' || host || '"]') AS fingerprint FROM r"""


def key_permissions(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("/k/id_"), k.cast("string"), F.when(k % 3 == 0, ".pub").otherwise("")).alias("path"), F.when(k % 5 == 0, "windows").otherwise("linux").alias("os"), (k % 512).cast("int").alias("mode"))
    return configs.key_permissions(rows).select("path", "finding_id", "severity")


def service_account_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") == 3, configs.SERVICE_ACCOUNT_TOKEN).otherwise("/x").alias("path"))
    return configs.service_account_tokens(rows).select("c_custkey", "finding_id")


def split_env(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).when(F.col("c_custkey") % 4 == 1, F.concat("c_mktsegment", F.lit("="))).otherwise(F.concat("c_mktsegment", F.lit("="), "c_name", F.lit("=x"))).alias("entry"))
    return tx.split_env(rows).select("c_custkey", "source", "env_var", "text")


def scalars(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    a = F.regexp_replace(t, "[^A-Za-z0-9]", "")
    return documents(spark, sf_dir).select(
        "doc_id", F.round(sc.shannon_entropy(t), 6).alias("entropy"), sc.is_placeholder(a).alias("placeholder"), sc.mask_token(a).alias("masked"), sc.format_source(F.col("source"), F.col("doc_id") % 3).alias("place"), sc.plain_fingerprint(t).alias("fingerprint"),
        sc.fields_fingerprint(F.col("source"), F.lit("<&>"), F.regexp_replace(t, r'["\\\x00-\x1f]', "")).alias("fields"), sc.value_line(F.substring(t, 101, F.lit(12)), t).alias("line"),
        sc.is_null_device(F.concat(F.lit("C:\\x\\"), F.when(F.col("doc_id") % 2 == 0, "NUL").otherwise("n"))).alias("null_device"), sc.type_name(F.when(F.col("doc_id") % 2 == 0, "secret").otherwise("odd")).alias("type_name"),
    )


_SCALARS = r"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]', '', 'g') AS a FROM documents),
ch AS (SELECT doc_id, unnest(string_split(t, '')) AS c FROM d WHERE t <> ''), n AS (SELECT doc_id, c, count(*) AS n FROM ch GROUP BY ALL), e AS (SELECT doc_id, -sum(n / strlen(t) * log2(n / strlen(t))) AS e FROM n JOIN d USING (doc_id) GROUP BY ALL)
SELECT doc_id, round(coalesce(e, 0), 6) AS entropy, strlen(a) < 10 OR regexp_matches(a, '(?i)^(xxx|yyy|zzz|abc|123)') OR regexp_matches(a, '(?i)^x{5,}$') AS placeholder, substr(a, 1, 8) || '…(' || strlen(a) || ')' AS masked,
source || CASE WHEN doc_id % 3 > 0 THEN ':' || doc_id % 3 ELSE '' END AS place, sha256(t) AS fingerprint, sha256('["' || source || '","\u003c\u0026\u003e","' || replace(replace(replace(regexp_replace(t, '["\\\x00-\x1f]', '', 'g'), '&', '\u0026'), '<', '\u003c'), '>', '\u003e') || '"]') AS fields,
CASE WHEN substr(t, 101, 12) = '' OR regexp_matches(substr(t, 101, 12), '[&<>"'']') THEN 0 ELSE len(left(t, instr(t, substr(t, 101, 12)) - 1)) - len(replace(left(t, instr(t, substr(t, 101, 12)) - 1), chr(10), '')) + 1 END::INT AS line,
doc_id % 2 = 0 AS null_device, CASE WHEN doc_id % 2 = 0 THEN 'Secret' ELSE 'odd' END AS type_name FROM d LEFT JOIN e USING (doc_id)"""


def _cases(spark, sf_dir, docs: tuple) -> DataFrame:
    """path, content: documents of several shapes by doc_id, each with its text's base64 in it."""
    k, n = F.col("doc_id").cast("string"), F.col("doc_id") % len(docs)
    coded = F.regexp_replace(F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), "[\r\n]", "")
    content = F.lit(None).cast("string")
    for i, doc in enumerate(docs):
        content = F.when(n == i, doc(k, coded)).otherwise(content)
    return documents(spark, sf_dir).select(F.concat(F.lit("/n/"), k).alias("path"), content.alias("content"))


def _said(*parts) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))


_DOCKER_DOCS = (
    lambda k, b: _said('{"auths":{"https://r', k, '/":{"auth":"', _auth(k), '"},"q":{"identitytoken":"', k, '"}},"note":"', b, '","credHelpers":{"auth":5,"identitytoken":[1]}}'),
    lambda k, b: _said('{"auths":{"h":{"auth":7,"x":"', b, '"}}}'),
    lambda k, b: _said('{"auths":{"h":{"auth":"!!', b, '"},"t":{"identitytoken":"', k, '","username":null}}}'),
    lambda k, b: _said('{"auths":\r\n{"r', k, '":{"auth":" \\t', F.regexp_replace(_auth(k), "=+$", ""), '\\n"}}}\r\n'),
    lambda k, b: _said('{"auths":{"n":{"auth":"', F.base64(F.encode(_said("none", k), "UTF-8")), '"}}}'),
    lambda k, b: _said('{"auths":{"a":null,"b":{"auth":null},"c":{"auth":""},"d":{"identitytoken":"', b, 't"}}}'),
    lambda k, b: _said('{"auths":{"r":{"auth":"', b, '"}}'),
)


def _auth(k: Column) -> Column:
    """A user named by the id, whose password is the whole text."""
    return F.regexp_replace(F.base64(F.encode(F.concat(F.lit("u"), k, F.lit(":"), F.coalesce("text", F.lit(""))), "UTF-8")), "[\r\n]", "")


def docker(spark, sf_dir):
    auths = nested.docker_auths(_cases(spark, sf_dir, _DOCKER_DOCS))
    cols = ["path", "registry_host", "finding_id", "location", "fingerprint"]
    inline = nested.docker_inline_auth(auths).select(*cols, "username", F.col("has_password").cast("string").alias("has_password"), F.sha2("password", 256).alias("password_hash"))
    return inline.unionByName(nested.docker_identity_token(auths).select(*cols), allowMissingColumns=True)


_DOCKER = """WITH c AS (SELECT '/n/' || doc_id AS path, doc_id::VARCHAR AS k, doc_id % 7 AS c, coalesce(text, '') AS t FROM documents),
r AS (SELECT path, CASE c WHEN 0 THEN 'https://r' || k || '/' ELSE 'r' || k END AS registry_host, 'docker-registry-inline-auth' AS finding_id, 'auth' AS field, 'u' || k AS username, (t <> '')::VARCHAR AS has_password, sha256(t) AS password_hash FROM c WHERE c IN (0, 3)
UNION ALL SELECT path, CASE c WHEN 0 THEN 'q' WHEN 2 THEN 't' ELSE 'd' END, 'docker-registry-inline-identity-token', 'identitytoken', NULL, NULL, NULL FROM c WHERE c IN (0, 2, 5))
SELECT path, registry_host, finding_id, 'auths["' || registry_host || '"].' || field AS location, sha256('["' || finding_id || '","' || path || '","' || registry_host || '"]') AS fingerprint, username, has_password, password_hash FROM r"""

_TERRAFORM_DOCS = (
    lambda k, b: _said('{"credentials":{"a.io":{"token":"atlas.v1.', b, '"},"b.io":{"token":""},"c.io":null},"other":{"token":5}}'),
    lambda k, b: _said("credentials 'c.io' {\r\n x = 1\r\n token\t= \"atlas.v1.", b, '"\r\n}\ncredentials "d.io"{token="', k, '"}'),
    lambda k, b: _said('{"credentials":{"a":{"token":5,"x":"', b, '"}}}'),
    lambda k, b: _said('{"credentials":{}} credentials "e.io" { token = \'', b, "x' }"),
    lambda k, b: _said('{"credentials":{"f.io":{"token":"', k, '"}}'),
    lambda k, b: _said('credentials "g.io" { user = "', b, '" } token = "no"'),
)


def terraform(spark, sf_dir):
    return nested.terraform_creds(_cases(spark, sf_dir, _TERRAFORM_DOCS)).select("path", "host", "file_format", "token_prefix", "token_fragment", "location", "fingerprint")


_TERRAFORM = """WITH c AS (SELECT '/n/' || doc_id AS path, doc_id::VARCHAR AS k, doc_id % 6 AS c, base64(encode(coalesce(text, ''))) AS b FROM documents),
r AS (SELECT path, CASE c WHEN 0 THEN 'a.io' WHEN 1 THEN 'c.io' ELSE 'e.io' END AS host, CASE c WHEN 0 THEN 'json' ELSE 'hcl' END AS file_format, CASE c WHEN 3 THEN b || 'x' ELSE 'atlas.v1.' || b END AS token FROM c WHERE c IN (0, 1, 3) UNION ALL SELECT path, 'd.io', 'hcl', k FROM c WHERE c = 1)
SELECT path, host, file_format, substr(token, 1, 8) AS token_prefix, substr(token, 1, 8) || '…(' || strlen(token) || ')' AS token_fragment, 'credentials["' || host || '"].token' AS location, sha256('["terraform-cloud-credential","' || path || '","' || host || '"]') AS fingerprint FROM r"""

_MCP_DOCS = (
    lambda k, b: _said('{"mcpServers":{"s":{"command":"npx","args":["-y","@a/b","","--k', b, '"],"env":{"E":"v', b, '","F":""},"envVars":{"G":"w"}}},"other":1}'),
    lambda k, b: _said('{"mcpServers":{"s":{"command":"run","args":["-y","@a/b","","--k', b, '"],"env":{"E":"v', b, '","F":""},"envVars":{"G":"w"}}},"other":{"args":5,"env":[1],"command":{"mcpServers":7}}}'),
    lambda k, b: _said('{"mcpServers":{"s":{"args":"', b, '"}}}'),
    lambda k, b: _said('{"mcpServers":{"s":{"command":"run","env":{"E":5,"F":"', b, '"}}}}'),
    lambda k, b: _said('{"mcpServers":\r\n{"n":null,"m":{"args":null,"env":{"E":"v', b, '"}}}}'),
    lambda k, b: _said('{"mcpServers":{"s":{"command":"run","args":["', b, '"]}}'),
)


def mcp(spark, sf_dir):
    return nested.mcp_values(_cases(spark, sf_dir, _MCP_DOCS)).select("path", "server", "command", "location", "env_var", F.sha2("text", 256).alias("text_hash"))


_MCP = """WITH d AS (SELECT '/n/' || doc_id AS path, doc_id % 6 AS c, base64(encode(coalesce(text, ''))) AS b FROM documents), c AS (SELECT *, CASE c WHEN 0 THEN 'npx' ELSE 'run' END AS command FROM d WHERE c < 2),
r AS (SELECT path, 's' AS server, command, 'env["E"]' AS place, 'E' AS env_var, 'v' || b AS text FROM c UNION ALL SELECT path, 's', command, 'envVars["G"]', 'G', 'w' FROM c UNION ALL SELECT path, 's', command, 'args[0]', '', '-y' FROM c
UNION ALL SELECT path, 's', command, 'args[1]', '', '@a/b' FROM c WHERE c = 1 UNION ALL SELECT path, 's', command, 'args[3]', '', '--k' || b FROM c UNION ALL SELECT path, 'm', '', 'env["E"]', 'E', 'v' || b FROM d WHERE c = 4)
SELECT path, server, command, 'mcpServers["' || server || '"].' || place AS location, env_var, sha256(text) AS text_hash FROM r"""

_IDE_DOCS = (
    lambda k, b: _said('<project version="4">\n<component name="RunManager">\n<configuration name="c', k, '">\n<parameters value="--t ', b, '"/>\n<envs>\n<env name="A" value="x&amp;y"/>\n<env name="B" value="z', k, '"/>\n</envs>\n</configuration>\n</component>\n<component name="Other"><configuration name="n"><parameters value="no"/></configuration></component>\n</project>'),
    lambda k, b: _said('<project><component name="RunManager"><configuration name="d"><parameters value="', k, '"/></configuration>\n<configuration name="e"><envs><env name="C" value="', b, '="/><env name="D" value=" "/></envs></configuration></component></project>'),
    lambda k, b: _said('<project><component name="RunManager"><configuration name="f"><parameters value="', b, '"/>'),
)


def ide(spark, sf_dir):
    return nested.ide_values(_cases(spark, sf_dir, _IDE_DOCS)).select("path", "config_name", "env_var", "line_number", F.sha2("text", 256).alias("text_hash"))


_IDE = """WITH c AS (SELECT '/n/' || doc_id AS path, doc_id % 3 AS c, doc_id::VARCHAR AS k, base64(encode(coalesce(text, ''))) AS b FROM documents),
r AS (SELECT path, 'c' || k AS config_name, '' AS env_var, 4 AS line_number, '--t ' || b AS text FROM c WHERE c = 0 UNION ALL SELECT path, 'c' || k, 'A', 0, 'x&y' FROM c WHERE c = 0 UNION ALL SELECT path, 'c' || k, 'B', 7, 'z' || k FROM c WHERE c = 0
UNION ALL SELECT path, 'd', '', 1, k FROM c WHERE c = 1 UNION ALL SELECT path, 'e', 'C', 2, b || '=' FROM c WHERE c = 1) SELECT path, config_name, env_var, line_number, sha256(text) AS text_hash FROM r"""


_DEEP = "[" * 3000
_KUBE_DOCS = (
    lambda k, b: _said("users:\n- name: u", k, "\n  user:\n    client-key-data: ", b, "\n    token-data: '!'\n- name: v\n  user: {}\n"),
    lambda k, b: _said("users:\n- name: u", k, "\n  user:\n    client-key-data: |\n      ", F.regexp_replace(b, "(.{60})", "$1\n      "), "\n"),
    lambda k, b: _said("users:\r\n- user: {token-data: '", F.regexp_replace(b, "=+$", ""), "', client-key-data: ~}\r\n  name: 2020-01-02\r\n---\r\n: : ["),
    lambda k, b: _said("users:\n- name: u", k, "\n  user:\n-\n"),
    lambda k, b: _said("users: {name: u", k, ", user: {token-data: ", b, "}}"),
    lambda k, b: _said("users: ", _DEEP),
    lambda k, b: _said("users: [{name: 7, user: {token-data: 1234}}, {name: 'n', user: {token-data: [x]}}]"),
    lambda k, b: _said("users: [{name: ~, user: {token-data: 1234}}]\nclusters: ", _DEEP, "]" * 3000, "\n"),
    lambda k, b: _said("one: &u {token-data: ", b, "}\nusers:\n- name: u", k, "\n  user: {<<: *u, other: [1, 2]}\n"),
    lambda k, b: _said("users: [{name: u, name: w, user: {token-data: ", b, "}}]"),
)


def kube(spark, sf_dir):
    return nested.kube_values(_cases(spark, sf_dir, _KUBE_DOCS)).select("path", "user_name", "field", "location", F.sha2("text", 256).alias("text_hash"))


_KUBE = """WITH d AS (SELECT '/n/' || doc_id AS path, doc_id % 10 AS c, doc_id::VARCHAR AS k, coalesce(text, '') AS t FROM documents)
SELECT path, CASE c WHEN 2 THEN '2020-01-02' WHEN 7 THEN '' ELSE 'u' || k END AS user_name, CASE WHEN c < 2 THEN 'client-key-data' ELSE 'token-data' END AS field, 'users[0].user.' || CASE WHEN c < 2 THEN 'client-key-data' ELSE 'token-data' END AS location,
sha256(CASE c WHEN 7 THEN chr(65533) || 'm' || chr(65533) ELSE t END) AS text_hash FROM d WHERE c = 7 OR c IN (0, 1, 2, 8) AND t <> ''"""

_HELM_DOCS = (
    lambda k, b: _said("repositories:\n- {name: r", k, ", url: 'https://c', username: '", b, "', password: p}\n- {name: open, url: 'https://o'}\n"),
    lambda k, b: _said("repositories:\n- name: 2020-01-01\n  url: 1e3\n  username: ", b, "\n  password: 123456\n"),
    lambda k, b: _said("repositories: [{name: r", k, ", username: '", b, "', password: ~}, {name: s, password: ''}]"),
    lambda k, b: _said("repositories: [{name: r", k, ", username: '", b, "', password: {a: 1}}]"),
    lambda k, b: _said("repositories: [{name: r", k, ", name: s, password: p}]"),
    lambda k, b: _said("repositories:\r\n- name: null\r\n  username: '", b, "'\r\n  password: true\r\n"),
    lambda k, b: _said("base: &b {url: 'u", k, "', password: 0x1F}\nrepositories: [{<<: *b, name: m, username: '", b, "'}]"),
    lambda k, b: _said("generated: ", _DEEP, "]" * 3000, "\nrepositories: [{name: d, username: '", b, "', password: p}]"),
    lambda k, b: _said("repositories: ", _DEEP),
    lambda k, b: _said("repositories: [{name: x, username: '", b, "', password: p, extra: {a: 1, a: 2}}]\n---\n]"),
)


def helm(spark, sf_dir):
    return nested.helm_repo_creds(_cases(spark, sf_dir, _HELM_DOCS)).select("path", "repo_name", "repo_url", "username", "username_present", "location", "fingerprint")


_HELM = """WITH d AS (SELECT '/n/' || doc_id AS path, doc_id % 10 AS c, doc_id::VARCHAR AS k, base64(encode(coalesce(text, ''))) AS username FROM documents),
r AS (SELECT path, CASE c WHEN 0 THEN 'r' || k WHEN 1 THEN '2020-01-01' WHEN 5 THEN '' WHEN 6 THEN 'm' WHEN 7 THEN 'd' ELSE 'x' END AS repo_name, CASE c WHEN 0 THEN 'https://c' WHEN 1 THEN '1e3' WHEN 6 THEN 'u' || k ELSE '' END AS repo_url, username FROM d WHERE c IN (0, 1, 5, 6, 7, 9))
SELECT *, username <> '' AS username_present, 'repositories["' || repo_name || '"]' AS location, sha256('["helm-repository-credential","' || path || '","' || repo_name || '"]') AS fingerprint FROM r"""

QUERIES = {
    "tag_files": tag_files, "max_depth": max_depth, "index_counts": index_counts, "route_probes": route_probes, "expand_base_dirs": expand_base_dirs, "exact_match": exact_match, "drop_expired_cache": drop_expired, "grace_filter": grace, "changed_since": changed_since, "even_sample": even_sample,
    "to_lines": lines, "parse_history": history, "parse_configs": parse_configs, "config_rules": config_rules, "ssh_config_rules": ssh_rules, "key_permissions": key_permissions, "service_account_tokens": service_account_tokens, "split_env": split_env, "scalar_functions": scalars,
    "docker_auths": docker, "terraform_creds": terraform, "mcp_values": mcp, "ide_run_configs": ide, "kube_values": kube, "helm_repo_creds": helm,
}

_ENABLED = "(VALUES ('aws_config', 'cloud', 0), ('aws_sso_cache', 'cloud', 2), ('sfdx_config', 'cloud', 26), ('rails_database_yml', 'cloud', 28), ('docker_context_keys', 'cloud', 30), ('env_files', 'env', 2), ('claude_chats', 'ai_chats', 2), ('codex_chats', 'ai_chats', 1), ('shell_history', 'shell_history', 0), ('gitconfig', 'git', 0)) AS v(pattern_name, probe, ord)"

ORACLES = {
    "tag_files": f"WITH {_TAGGED} SELECT doc_id, pattern_name FROM tags",
    "max_depth": f"WITH {_FILES} SELECT doc_id, path FROM f WHERE len(string_split(path, '/')) <= 3",
    "index_counts": f"WITH {_TAGGED} SELECT pattern_name, count(*) AS n FROM tags GROUP BY ROLLUP (pattern_name)",
    "route_probes": f"WITH {_TAGGED}, q AS (SELECT * FROM tags JOIN {_ENABLED} USING (pattern_name) QUALIFY row_number() OVER (PARTITION BY host_id, probe, path ORDER BY ord, size, doc_id) = 1) SELECT host_id, path, probe, pattern_name FROM q WHERE size <= 1048576",
    "expand_base_dirs": f"WITH {_FILES}, b AS (SELECT * FROM (VALUES ('/home/u'), ('/home/u/work'), ('/home/u/.ssh')) AS v(base_dir)) SELECT doc_id, base_dir, substr('/home/u/' || path, len(base_dir) + 2) AS rel_path FROM f, b WHERE starts_with('/home/u/' || path, base_dir || '/')",
    "exact_match": f"WITH {_FILES} SELECT doc_id, path FROM f WHERE regexp_matches(path, '(^|/)[.]env$') OR path = 'src/CLAUDE.md'",
    "drop_expired_cache": "SELECT event_id FROM events WHERE event_id % 4 > 1 OR date_trunc('second', ts) + INTERVAL 60 SECOND >= TIMESTAMP '2024-01-15'",
    "grace_filter": "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-15' - INTERVAL 90 MINUTE",
    "changed_since": "WITH o AS (SELECT o_custkey % 10 AS host_id, o_orderkey::VARCHAR AS path, o_orderkey AS k FROM orders) SELECT host_id, path, CASE WHEN k % 5 = 2 THEN 'missing' WHEN k % 7 = 1 THEN 'new' ELSE 'modified' END AS status FROM o WHERE (k % 5 = 2) <> (k % 7 = 1) OR (k % 5 <> 2 AND k % 7 <> 1 AND k % 3 = 0)",
    "even_sample": f"WITH {_FILES}, s AS (SELECT host_id, path || '#' || lpad(doc_id::VARCHAR, 9, '0') AS path FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY path) - 1 AS i, count(*) OVER (PARTITION BY host_id) AS n FROM s) SELECT host_id, path FROM n WHERE n <= 7 OR i IN (SELECT floor(k * n / 7.0::DOUBLE) FROM range(7) AS r(k))",
    "to_lines": f"WITH {_LINES}, s AS (SELECT *, max(strlen(line) >= 1048576) OVER (PARTITION BY doc_id ORDER BY line_number) AS stopped FROM l) SELECT doc_id, line_number, sha256(line) AS line_hash FROM s WHERE NOT stopped AND trim(line, chr(32) || chr(9) || chr(13)) <> ''",
    "parse_history": _HISTORY,
    "parse_configs": f"WITH {_CONFIG} SELECT path, key, value, line_number FROM kv",
    "config_rules": f"WITH {_CONFIG}, {_RULES}",
    "ssh_config_rules": _SSH,
    "key_permissions": "SELECT '/k/id_' || c_custkey AS path, 'ssh-key-insecure-permissions' AS finding_id, 'high' AS severity FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 64 <> 0",
    "service_account_tokens": "SELECT c_custkey, 'k8s-service-account-token' AS finding_id FROM customer WHERE c_nationkey = 3",
    "split_env": "SELECT c_custkey, 'env:' || c_mktsegment AS source, c_mktsegment AS env_var, c_name || '=x' AS text FROM customer WHERE c_custkey % 4 > 1",
    "scalar_functions": _SCALARS,
    "docker_auths": _DOCKER, "terraform_creds": _TERRAFORM, "mcp_values": _MCP, "ide_run_configs": _IDE, "kube_values": _KUBE, "helm_repo_creds": _HELM,
}
