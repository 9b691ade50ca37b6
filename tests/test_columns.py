"""Column builders on small literals."""

import re

import pytest
from pyspark.sql import functions as F

from sessionmine.functions import cards as cf, errors as ef, paths as pf, redaction as rf, text as tf, versions as vf
from sessionmine.functions import wordlists as wl


@pytest.mark.parametrize("text,want", [
    ("The a-b Store_1 x 7 of", ["store_1", "7"]),
    ("折扣计算", ["折扣", "扣计", "计算"]),
    ("中 我们的abc", ["中", "们的", "abc"]),
    ("我", ["我"]),
    ("pnpm不要npm", ["pnpm", "不要", "npm"]),
    ("", []), ("été über naïve", ["ber", "na", "ve"]),
])
def test_tokens(column, text, want):
    assert column(tf.tokens, text) == want


def test_tokens_of_null(spark):
    assert spark.range(1).select(tf.tokens(F.lit(None).cast("string")).alias("t")).first().t == []


def test_norm_key(column):
    assert column(tf.norm_key, "Use PNPM，不要 npm！") == column(tf.norm_key, "use pnpm 不要npm")


def test_sentences(column):
    assert column(tf.sentences, "我喜欢用 pnpm。ok. Please run it now! Yes") == ["我喜欢用 pnpm", "Please run it now!"]


def test_clips(column):
    assert column(lambda c: tf.clip_head(c, 5), "abcdefg") == "abcd…"
    assert column(lambda c: tf.clip_head_tail(c, 10), "0123456789abcdef") == "012345…def"
    assert column(lambda c: tf.gist(F.lit(None).cast("string"), c), "In 0.2.4 do it. Then rest") == "In 0.2.4 do it."
    assert column(tf.compact_rule, "Never commit. " + "x" * 80) == "Never commit. " + "x" * 45 + "…"
    assert column(tf.compact_rule, "绝不自动提交代码；" + "x" * 80) == "绝不自动提交代码；"
    assert column(tf.compact_entry, "A long title\nsaid: A long title again") == "said: A long title again"


SECRETS = [
    ("key sk-" + "a" * 20, "key [REDACTED:openai-key]"), ("ghp_" + "B" * 24, "[REDACTED:github-token]"),
    ("AKIA" + "Z" * 16 + " x", "[REDACTED:aws-key] x"), ("a xoxb-" + "1" * 12, "a [REDACTED:slack-token]"),
    ("Bearer " + "t" * 24, "[REDACTED:bearer]"), ("password = hunter22", "[REDACTED:named-secret]"),
    ("db://user:pa" + "ssword@host", "db[REDACTED:uri-credentials]host"), ("plain text stays", "plain text stays"),
    ("-----BEGIN RSA PRIVATE KEY-----\nxx\n-----END RSA PRIVATE KEY-----", "[REDACTED:private-key]"),
]


@pytest.mark.parametrize("text,want", SECRETS)
def test_redact(column, text, want):
    assert column(rf.redact, text) == want


@pytest.mark.parametrize("text,want", [
    ("a\u001b[31mred\u001b[0m", "ared"), ("t\u001b]0;title\u0007x", "tx"), ("- [long-term] fake", "• [long-term] fake"),
    ("- [x] task", "- [x] task"), ("A -[hidden]-> B", "A -[hidden]-> B"), ("a\u0000b\tc", "ab\tc"),
])
def test_sanitize(column, text, want):
    assert column(rf.sanitize, text) == want


def test_sanitize_braces(column):
    assert column(lambda c: rf.sanitize(c, neutral_braces=True), "a {{{x}} \n b") == "a { { {x}} b"


def test_template_groups_errors(column):
    a = "Cannot find module 'aaa' at /work/a/node_modules/index.js:12:3"
    b = "Cannot find module 'bbbb' at /work/b/node_modules/other.js:987:41"
    assert column(ef.error_template, a) == column(ef.error_template, b) == "Cannot find module LITERAL at FILE"
    assert column(ef.error_template, "\n  Unsupported version 61 for 1.20.1") == "Unsupported version N for VER"
    assert column(ef.error_template, "listen :3000 then :8080") == "listen :PORT then :N"
    assert column(ef.error_template, "took 12.5 ms at 2024-01-02T10:11:12Z") == "took DURATION at TIMESTAMP"
    assert column(ef.error_template, "   ") == ""


def test_fingerprints(column):
    fp = lambda *v: column(ef.fingerprint, *v)
    assert fp("bash", "E", "C", "t") != fp("bash", "F", "C", "t")
    assert fp("bash", "E", "C", "") is None
    assert column(ef.semantic_fingerprint, "a b") is None
    assert column(ef.semantic_fingerprint, "Don't do that!") == column(ef.semantic_fingerprint, "dont do  that")


def test_guard_literal(column):
    g = lambda s: column(ef.guard_literal, s)
    assert g('{"command": "npm run lint"}') == "npm run lint"
    assert g('{"command": "cat /etc/x"}') is None
    assert g('{"other": "hello"}') == "hello" and g('{"command": "ls"}') is None


@pytest.mark.parametrize("version,constraint,want", [
    ("1.20.1", "~1.20", True), ("1.21.0", "~1.20", False), ("1.20.5", ">=1.20 <1.21", True), ("1.20.1", "1.20", True),
    ("1.20.1", "1.20.x", True), ("1.201", "1.20", False), ("1.99.0", "^1.20", True), ("2.0.0", "^1.20", False), ("9.9.9", "", True),
    ("1.20", "=1.20.0", True), ("1.9", "<1.20", True), ("v1.20.1-rc.1", ">=1.20.1", True),
])
def test_versions(column, version, constraint, want):
    assert column(vf.satisfies, version, constraint) is want


def _stack(**kw):
    base = dict(ecosystem=None, languages=[], frameworks=None, framework_versions=None, version_constraints=None, versions=None, sdks=None, build_tool=None)
    return {**base, **kw}


@pytest.mark.parametrize("a,b,want", [
    (None, _stack(languages=["java"]), True), (_stack(languages=["java"]), _stack(languages=["kotlin"]), False),
    (_stack(languages=["java"]), _stack(languages=["kotlin", "java"]), True), (_stack(ecosystem="x"), _stack(ecosystem="y"), False),
    (_stack(version_constraints={"k": "~1.20"}), _stack(versions={"k": "1.21.0"}), False),
    (_stack(version_constraints={"k": "~1.20"}), _stack(versions={"other": "1"}), True),
    (_stack(frameworks=["react"]), _stack(frameworks=["vue"]), False),
])
def test_compatible(spark, a, b, want):
    from sessionmine.schemas import STACK
    df = spark.createDataFrame([(a, b)], f"a {STACK}, b {STACK}")
    assert df.select(vf.compatible("a", "b").alias("r")).first().r is want


@pytest.mark.parametrize("text,files,want", [
    (None, [], True), ("just prose here", ["src/a.ts"], True), ("module=settlement", [], True), ("module=settlement", ["src/order.ts"], False),
    ("module=settlement", ["src/Settlement/x.ts"], True), ("mc=1.21.1", [], False), ("mc=1.20.1", [], True), ("branch=main", ["x"], True),
])
def test_applies_to(spark, text, files, want):
    from sessionmine.schemas import STACK
    df = spark.createDataFrame([(text, files, _stack(versions={"minecraft": "1.20.1"}))], f"t string, f array<string>, s {STACK}")
    assert df.select(vf.applies_to("t", "f", F.col("s")).alias("r")).first().r is want


def test_deidentify(column):
    d = lambda t, ids: column(rf.deidentify, t, ids)
    assert d("OrderService calls com.acme.orders and OrderService", ["com.acme.orders", "OrderService"]) == "<Class1> calls <pkg1> and <Class1>"
    assert d("JSON stays, see /home/me/secret/x.txt", ["JSON"]) == "JSON stays, see [PATH]"
    auto = lambda c: rf.deidentify(c, F.array().cast("array<string>"), auto_detect=True)
    assert column(auto, "OrderPolicy in com.acme.shop") == "<Class1> in <pkg1>"


def test_identifiers_from_paths(column):
    assert column(rf.identifiers_from_paths, ["src/OrderService.java", "store.ts", "docs/plantuml.txt", "x/longenough.py"]) == ["OrderService", "longenough"]


def test_external_paths(column):
    s = lambda t: column(lambda c: rf.scrub_external_paths(c, F.lit("/ws")), t)
    assert s("see /ws/src/a.ts and /etc/ssh/key") == "see /ws/src/a.ts and [EXTERNAL-PATH]"


@pytest.mark.parametrize("path,role,lang", [
    ("src/service/A.ts", "service-layer", "typescript"), ("test/x.py", "test", "python"), ("pom.xml", "build-config", "xml"),
    ("lib/OrdersClient.java", "api-client", "java"), ("src/OrderPolicy.java", "domain-model", "java"), ("config/a.rb", "config", "ruby"), ("a/b.rs", "other", "rust"),
])
def test_roles(column, path, role, lang):
    assert (column(pf.role_of, path), column(pf.language_of, path)) == (role, lang)


def test_files(column):
    assert column(pf.files_from_arguments, '{"file_path": "/ws/a.ts", "path": "b"}') == ["/ws/a.ts", "b"]
    assert column(lambda c: pf.keep_inside(c, F.lit("/ws")), ["/ws/src/a.ts", "/etc/x", "./b.ts", "../c", "b.ts"]) == ["src/a.ts", "b.ts"]
    assert column(pf.files_from_prose, "改 src/store.ts and (test/a.test.ts) http://x.ts") == ["src/store.ts", "test/a.test.ts"]


def test_action_terms(column):
    raw = '{"file_path": "docs/design/GTEnchantment.java", "status": "in_progress", "command": "configurable Budget", "list": ["DataComponents", {"path": "NoNoName"}], "why": "Fresh 附魔 analysis"}'
    assert column(pf.action_terms, raw) == ["enchantment", "java", "data", "components", "附魔"]
    assert column(pf.action_terms, "not json") == []


def test_evidence(column):
    r = lambda t: column(cf.evidence_reason, t)
    assert r("re-ran `npm test`: 240/240 pass") is None
    assert r("works") == "content_free" and r("已采用，效果良好") == "content_free" and r("通过") == "content_free"
    assert r("240/240") == "too_short" and r("") == "empty" and r(None) == "not_text"
    assert r("这个技巧我照着做了而且觉得挺顺利的") == "no_observation"


def test_needles(column):
    n = lambda *s: column(cf.reference_needles, list(s))
    assert n("<Class1>.setPropertyOverride", "apply", "Machine GUI screen class") == ["setPropertyOverride"]
    assert n("JSON.parse", "readFileSync", "Array.isArray") == []
    assert n("ItemStack.getOrDefault", "tools.register") == ["ItemStack.getOrDefault", "getOrDefault", "tools.register"]


def test_mentions(column):
    assert column(cf.mentions, "ctx.tools.register(x)", "tools.register") is True
    assert column(cf.mentions, "registerAllNow", "registerAll") is False
    assert column(cf.mentions, "call registerAll()", "registerAll") is True


def test_word_edges_ignore_accents(column):
    # A letter with an accent is no word character here.
    assert column(tf.symbols_in_text, "édata.call xé") == ["data.call"]
    assert re.match(r"\w", "é") and wl.START
