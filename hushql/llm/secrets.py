"""Secret scanning with linking of credential parts, in built-in expressions only.

Base kinds: assignments, access identifiers and long hex runs. Linking adds parts that are weak alone: an unnamed secret, an
account name and an endpoint. A weak part is reported only where a complementary part lies in its scope, that is in its paragraph (blank
lines end one) or within SCOPE code points: a secret near an access identifier, endpoint or account, an endpoint near an identifier, secret
or account, an account near an endpoint or a secret. A run inside an endpoint or account is no complement of it, save one of 40 characters.
Scopes are joined as intervals inside the row, by halving sorted places: nothing is shuffled, no pair is looked at twice.

Places are code points, ends exclusive. Null texts count as empty. Repeated rows give repeated results. Texts may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushql.llm.common import first_at, whole_text

SCOPE = 200
KEYWORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = KEYWORD + "[\"\\x27]?\\x20*[:=]\\x20*[\"\\x27]?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Weak alone. Its runs are whole: nothing of the same letters stands at either side. Below 32 characters a letter and a digit tell one from a long word.
SECRET = "(?<![A-Za-z0-9+/=])(?:(?=[A-Za-z+/]*+[0-9])(?=[0-9+/]*+[A-Za-z])[A-Za-z0-9+/]{20,}+|[A-Za-z0-9+/]{32,}+)={0,2}+(?![A-Za-z0-9+/=])"
ACCOUNT = "(?:user(?:name)?|login|account)[\"\\x27]?\\x20{0,3}[:=]\\x20{0,3}[\"\\x27]?[A-Za-z0-9_.@-]{3,}"
ENDPOINT = "(?:https?|ftp|jdbc:[a-z]{2,16}|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9_.:@/-]{4,}"
BREAK = "\\n[\\x20\\t\\r]*\\n"
KINDS = ("assign", "access", "hex", "secret", "account", "endpoint", "break")
SPAN = "struct<s:int,k:int,e:int>"
#: Code points of the pieces that a masked text is put together from.
PIECE = 1024


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scanned(numbers: str, of: str) -> str:
    """SQL: running ``of`` (of ``y`` and ``z``) over an array of numbers.

    An aggregate that appends to an array copies it for each item; this takes one pass for each doubling of the reach.
    """
    step = f"transform(c, (y, j) -> if(j >= shiftleft(1, d), element_at(transform(array(c[j - shiftleft(1, d)]), z -> {of}), 1), y))"
    return f"aggregate(sequence(0, cast(ceil(log2(greatest(size({numbers}), 1))) as int)), {numbers}, (c, d) -> {step})"


def spans(kind: str, pattern: str, keep: str = "true") -> Column:
    """Places of leftmost non-overlapping matches in ``text_``.

    The pieces between matches come from a split; a first cheap look spares the texts without any match both passes.
    """
    p, k = _quoted(pattern), KINDS.index(kind)
    matches, between = f"regexp_extract_all(text_, {p}, 0)", f"split(text_, {p}, -1)"
    ends = scanned("r.n", "y + z")
    placed = f"transform({ends}, (e, i) -> named_struct('s', e - length(r.m[i]), 'k', {k}, 'e', e, 'keep', element_at(transform(array(r.m[i]), m -> {keep}), 1)))"
    sized = f"transform(array({matches}), m -> named_struct('m', m, 'n', transform(slice({between}, 1, size(m)), (b, i) -> length(b) + length(m[i]))))"
    made = f"element_at(transform({sized}, r -> {placed}), 1)"
    return F.expr(f"if(rlike(text_, {p}), transform(filter({made}, x -> x.keep), x -> named_struct('s', x.s, 'k', x.k, 'e', x.e)), cast(array() as array<{SPAN}>))")


def _scoped(weak: str) -> Column:
    """Weak spans with their scopes: the paragraph, or SCOPE code points to either side where that is more."""
    low = f"element_at(transform(array({first_at('breaks_', 'y.e > w.s')}), i -> if(i = 1, 0, element_at(breaks_, i - 1).e)), 1)"
    high = f"element_at(transform(array({first_at('breaks_', 'y.s >= w.e')}), i -> if(i > size(breaks_), length(text_), element_at(breaks_, i).s)), 1)"
    return F.expr(f"transform({weak}, w -> named_struct('w', w, 'low', least(w.s - {SCOPE}, {low}), 'high', greatest(w.e + {SCOPE}, {high})))")


def _near(weak: str, *parts: str) -> Column:
    """Weak spans with a complement in scope.

    Spans of one kind are sorted and apart, so those in a scope are a range of places, and so are those that overlap the
    weak span; both ends are found by halving.
    """
    tests = []
    for part in parts:
        in_scope = f"{first_at(part, 'y.s >= x.high')} - {first_at(part, 'y.e > x.low')}"
        if "secret_" not in (weak, part):
            tests.append(f"{in_scope} > 0")
            continue
        # A run inside an endpoint or account is no complement, save one of 40 characters.
        clear = f"{in_scope} > {first_at(part, 'y.s >= x.w.e')} - {first_at(part, 'y.e > x.w.s')}"
        if weak == "secret_":
            tests.append(f"if(x.w.e - x.w.s = 40, {in_scope} > 0, {clear})")
        else:
            tests.append(f"({clear} or {first_at('secret40_', 'y.s >= x.high')} > {first_at('secret40_', 'y.e > x.low')})")
    used = [f"(size({part}) > 0 and {test})" for part, test in zip(parts, tests)]
    return F.expr(f"transform(filter({weak}in_, x -> {' or '.join(used)}), x -> x.w)")


def found(docs: DataFrame) -> DataFrame:
    """doc (all columns of ``docs``), text_ and arrays of base and weak spans of every row's whole text."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), whole_text().alias("text_"))
    rows = rows.select("*", spans("assign", ASSIGN, f"length(regexp_extract(m, {_quoted(ASSIGN)}, 2)) >= 6").alias("assign_"), spans("access", ACCESS).alias("access_"), spans("hex", HEX).alias("hex_"))
    rows = rows.select("*", spans("secret", SECRET).alias("secret_"), spans("account", ACCOUNT).alias("account_"), spans("endpoint", ENDPOINT).alias("endpoint_"))
    weak_any = F.expr("size(secret_) + size(account_) + size(endpoint_) > 0")
    rows = rows.select("*", F.when(weak_any, spans("break", BREAK)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)")).alias("breaks_"), F.expr("filter(secret_, x -> x.e - x.s = 40)").alias("secret40_"))
    rows = rows.select("*", *[_scoped(weak).alias(f"{weak}in_") for weak in ("secret_", "account_", "endpoint_")])
    named = ("assign_", "hex_", "secret_")
    near = [_near("secret_", "access_", "endpoint_", "account_"), _near("account_", "endpoint_", *named), _near("endpoint_", "access_", "account_", *named)]
    return rows.select("doc", "text_", "assign_", "access_", "hex_", F.array_sort(F.concat("assign_", "access_", "hex_")).alias("base_"), F.array_sort(F.concat("assign_", "access_", "hex_", *near)).alias("spans_"))


def joined(column: str) -> Column:
    names = f"element_at(array({', '.join(repr(k) for k in KINDS)}), x.k + 1)"
    return F.expr(f"array_join(transform({column}, x -> concat({names}, ':', x.s, ':', x.e)), ',')")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of every row's whole text."""
    rows = found(docs.select("doc_id", "text"))
    size = lambda c: F.size(c).cast("long")
    return rows.select("doc.doc_id", size("assign_").alias("n_assign"), size("access_").alias("n_access"), size("hex_").alias("n_hex"), F.sha2(joined("base_").cast("binary"), 256).alias("base_sha256"), joined("spans_").alias("spans"))


def _masked() -> Column:
    """text_ with each group of overlapping spans read as [SECRET], put together from pieces of PIECE code points."""
    reach = f"transform(array({scanned('transform(spans_, x -> x.e)', 'greatest(y, z)')}), c -> transform(spans_, (x, i) -> named_struct('s', x.s, 'e', c[i], 'new', i = 0 or x.s >= c[greatest(i - 1, 0)])))"
    # A group begins at its first span and ends where the next begins anew.
    groups = f"transform({reach}, r -> arrays_zip(transform(filter(r, x -> x.new), x -> x.s), transform(filter(r, (x, i) -> i = size(r) - 1 or r[least(i + 1, size(r) - 1)].new), x -> x.e)))"
    piece = f"""transform(array(named_struct('from', i * {PIECE}, 'j', {first_at('g', f'y.`1` > i * {PIECE}')}, 'n', {first_at('g', f'y.`0` >= (i + 1) * {PIECE}')} - {first_at('g', f'y.`1` > i * {PIECE}')})), v -> if(v.n <= 0, t, concat(
        array_join(transform(sequence(v.j, v.j + v.n - 1), k -> element_at(transform(array(named_struct('b', if(k = v.j, v.from, element_at(g, k - 1).`1`), 's', element_at(g, k).`0`)), y -> concat(substring(t, y.b - v.from + 1, greatest(0, y.s - y.b)), if(y.s >= v.from, '[SECRET]', ''))), 1)), ''),
        substring(t, element_at(g, v.j + v.n - 1).`1` - v.from + 1, {PIECE}))))"""
    whole = f"transform({groups}, g -> array_join(transform(regexp_extract_all(text_, '(?s).{{1,{PIECE}}}', 0), (t, i) -> element_at({piece}, 1)), ''))"
    return F.expr(f"element_at({whole}, 1)")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every reported span read as [SECRET]; spans that overlap are one. n_chars follows where it exists."""
    rows = found(docs)
    rows = rows.select("doc", F.when(F.size("spans_") > 0, _masked()).alias("masked"))
    changed = {"text": F.coalesce("masked", "doc.text"), "n_chars": F.coalesce(F.length("masked").cast("bigint"), "doc.n_chars") if "n_chars" in docs.columns else None}
    return rows.select(*[changed[c].alias(c) if changed.get(c) is not None else F.col("doc")[c].alias(c) for c in docs.columns])
