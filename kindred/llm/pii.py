"""Personal data in texts, by weak supervision, with DataFrame and SQL functions only.

Base spans (email, ip, card, phone) follow fixed patterns and tests and always stay. Further
candidates (written-out emails, phones without a country code, card-like numbers that fail
the checksum, secrets) are voted on by labelers: a strict pattern, a gazetteer, the context
before the span, and its shape; each votes for, against or not at all. Expectation-
maximisation over the counts of vote patterns (at most 3 to the number of labelers for a
kind, whatever the corpus) estimates how reliable each labeler is. A logistic span classifier
is then trained on the resulting posteriors. It does not see the votes: its inputs are binary
features of the span, its listed parts and the text on either side, so it also weighs what no
labeler looks at. It adds the candidates that it takes for personal data and that overlap no
base span. Both fits are folds over one array of pattern counts within one row a kind.

Patterns hold no group that is repeated by backtracking, on which Java's matcher would use
its stack once a repetition: repeated groups are possessive, which loops and, as none of
them can end in two ways, finds the same matches. Starts and ends are code points, end
exclusive. They come from the pieces that split() leaves between the matches of
regexp_extract_all(): both run the same pattern over the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
# A start inside a run of the same class can't match if the run's start didn't, unless the last match ended there (\G):
# so these give the leftmost non-overlapping matches of the plain patterns without trying every start of long runs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
# Matches of the card pattern are maximal, so those below 14 digits, which would be dropped, need not match.
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
IP_VALID = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

# Gazetteers.
TLDS = "com net org edu gov mil int info biz name pro io ai app dev co me tv cloud online site shop store tech xyz eu de fr es it uk us ca au nz at ch nl be lu pl pt se no dk fi is ie cz sk hu ro bg gr hr si ee lv lt ru ua by tr il sa ae in pk cn jp kr tw hk sg my th vn id ph br mx ar cl pe za ng ke eg ma example test"
MAIL_HOSTS = "gmail googlemail yahoo ymail hotmail outlook live msn icloud aol gmx web proton protonmail fastmail yandex zoho qq 163 126 t-online freenet orange wanadoo laposte libero terra telefonica"
#: First digits of card numbers by issuer: Visa, Mastercard, American Express, Diners Club, JCB, Discover, UnionPay, Maestro.
ISSUERS = "4 5[1-5] 222[1-9] 22[3-9] 2[3-6] 27[01] 2720 3[47] 30[0-5] 3[689] 352[89] 35[3-8] 6011 64[4-9] 65 62 50 5[6-8]"
#: Area codes of services, not persons.
SERVICES = "800 833 844 855 866 877 888 900 911"
#: Beginnings of access tokens and keys.
TOKENS = "sk- pk- sk_ pk_ rk_ ghp_ gho_ ghu_ ghs_ github_pat_ glpat- xox[abprs]- AKIA ASIA AIza ya29 eyJ SG[.] npm_ pypi- hf_ shpat_ dop_v1_"
MAIL_WORDS = "mail contact write reach address kontakt schreib adresse courriel contacter adresse correo contacto escrib"
PHONE_WORDS = "phone tel call mobile fax cell text whatsapp anruf telefon handy rufnummer portable appel numéro móvil teléfono llam"
CARD_WORDS = "card visa mastercard credit debit amex payment karte kredit zahlung carte paiement tarjeta crédito pago"
SECRET_WORDS = "token secret key password passwd pwd auth bearer credential passwort kennwort schlüssel clé passe contraseña clave"
NUMBER_WORDS = "order invoice ticket ref id no. nr. number isbn serial part version bestell rechnung commande facture pedido factura"
DIGEST_WORDS = "sha md5 commit hash checksum digest etag revision"


def _any(words: str) -> str:
    return "(" + "|".join(words.split()) + ")"


def _has(column: str, words: str) -> str:
    return f"c.{column} rlike '{_any(words)}'"


#: Candidate patterns; what must be in a text for the pattern to be tried; votes of the four labelers (strict,
#: gazetteer, context, shape) and the classifier's features, as SQL over c.t (the span), c.pre and c.post (up to 40
#: and 12 code points on its sides, lower-cased, as far as the next candidates).
CANDIDATES = {
    "email": (
        r"(?<![A-Za-z0-9_%+.-])[A-Za-z0-9_%+.-]++(?:\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++",
        r"[\[(\x20]dot[\])\x20]",
        (
            r"if(c.t rlike '[(\\[]', 1, 0)",
            f"if(lower(c.t) rlike '[^a-z0-9]{_any(MAIL_HOSTS)}[^a-z0-9]|[^a-z]{_any(TLDS)}$', 1, -1)",
            f"if({_has('pre', MAIL_WORDS)}, 1, 0)",
            "if(length(c.t) <= 80, 1, -1)",
        ),
        (
            r"c.t rlike '[(\\[]'",
            f"lower(c.t) rlike '[^a-z]{_any(TLDS)}$'",
            f"lower(c.t) rlike '[^a-z0-9]{_any(MAIL_HOSTS)}[^a-z0-9]'",
            _has("pre", MAIL_WORDS),
            "c.t rlike '^[^ (]*[0-9._-]'",
            "length(c.t) <= 50",
            "c.pre rlike '[:<(=] ?$'",
        ),
    ),
    "phone": (
        r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-]|\.[0-9])",
        r"[0-9]{3}[\x20.-][0-9]{4}",
        (
            r"if(c.t rlike '\\([0-9]{3}\\)|[0-9]{3}-[0-9]{3}-', 1, 0)",
            f"if(not c.t rlike '^[(]?[2-9][0-8][0-9][^0-9]+[2-9]' or c.t rlike '^[(]?{_any(SERVICES)}', -1, 1)",
            f"if({_has('pre', PHONE_WORDS)}, 1, if({_has('pre', NUMBER_WORDS)}, -1, 0))",
            r"if(c.t rlike '([0-9])\\1{5}', -1, 0)",
        ),
        (
            r"c.t rlike '\\([0-9]{3}\\)'",
            "c.t rlike '[0-9]{3}([ .-])[0-9]{3}\\\\1'",
            "c.t rlike '^[(]?[2-9][0-8][0-9][^0-9]+[2-9]'",
            f"c.t rlike '^[(]?{_any(SERVICES)}'",
            _has("pre", PHONE_WORDS),
            _has("pre", NUMBER_WORDS),
            "c.pre rlike '[0-9][ .-]?$' or c.post rlike '^ ?[0-9]'",
        ),
    ),
    "card": (
        r"(?<![0-9A-Za-z.-])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9A-Za-z-])",
        r"[0-9]{4}[\x20-]?[0-9]{4}",
        (
            "if(c.t rlike '[0-9]{4}[ -][0-9]{4}', 1, -1)",
            f"if(c.t rlike '^{_any(ISSUERS)}', 0, -1)",
            f"if({_has('pre', CARD_WORDS)}, 1, -1)",
            r"if(c.t rlike '([0-9])\\1{5}', -1, 0)",
        ),
        (
            "c.t rlike '[0-9]{4}([ -])[0-9]{4}\\\\1[0-9]{4}\\\\1'",
            f"c.t rlike '^{_any(ISSUERS)}'",
            _has("pre", CARD_WORDS),
            _has("pre", NUMBER_WORDS),
            r"c.t rlike '([0-9])\\1{5}'",
            "c.pre rlike '[:#=] ?$'",
        ),
    ),
    "secret": (
        r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{24,}+=*+",
        r"[A-Za-z0-9+/_-]{24}",
        (
            "if(c.t rlike '^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$', 1, 0)",
            f"if(c.t rlike '^{_any(TOKENS)}', 1, 0)",
            f"if(c.pre rlike '{_any(SECRET_WORDS)}[^a-z]{{0,6}}$', 1, if({_has('pre', DIGEST_WORDS)}, -1, if({_has('pre', SECRET_WORDS)}, 0, -1)))",
            "if(length(regexp_replace(c.t, '[^0-9]', '')) between 4 and length(c.t) - 4, 1, -1)",
        ),
        (
            f"c.t rlike '^{_any(TOKENS)}'",
            f"c.pre rlike '{_any(SECRET_WORDS)}[^a-z]{{0,6}}$'",
            _has("pre", DIGEST_WORDS),
            "c.t rlike '[A-Z]' and c.t rlike '[a-z]' and c.t rlike '[0-9]'",
            "c.t rlike '^[0-9a-f]+$'",
            "length(regexp_replace(c.t, '[^0-9]', '')) * 10 >= length(c.t)",
            "c.t rlike '[a-z]{8}|[A-Z]{8}|[/].*[/]'",
            "length(c.t) > 100",
        ),
    ),
}
LABELERS = 4
_TEXT = "pii_text_"  # a column of this name may not be in the input
_SPAN, _NEAR = "struct<s:int,e:int,t:string>", "struct<s:int,e:int,t:string,pre:string,post:string>"


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL: body, in which name stands for value, worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def running(values: str, op: Callable[[str, str], str], start: int) -> str:
    """SQL: for each place of an array of int, start and the values before it folded by op, which is associative.

    Appending to an array copies it, so places are folded in about sqrt(size) blocks, and the
    blocks' totals give each its start: the cost is size to the power 1.5 and not squared.
    """
    none = "cast(array() as array<int>)"

    def fold(k: str, p: str) -> str:
        return f"aggregate({k}, named_struct('p', {p}, 'a', {none}), (z, x) -> named_struct('p', {op('z.p', 'x')}, 'a', concat(z.a, array(z.p))), z -> z.a)"

    cut = _let("n", "cast(ceil(sqrt(size(q))) as int)", "transform(sequence(0, (size(q) - 1) div n), i -> slice(q, cast(i * n + 1 as int), n))")
    total = f"transform(b, k -> aggregate(k, {start}, (z, x) -> {op('z', 'x')}))"
    each = _let("b", cut, f"flatten(zip_with(b, {fold(total, str(start))}, (k, p) -> {fold('k', 'p')}))")
    return _let("q", values, f"if(size(q) = 0, {none}, {each})")


def located(text: str, pattern: str, near: bool = False) -> str:
    """SQL: the matches of a pattern as array<struct<s,e,t>>; near: with pre and post, what is on either side, lower-cased."""
    sides = "'pre', lower(right(l.y, 40)), 'post', lower(left(l.z, 12))"
    pieces = "zip_with(zip_with(w.m, slice(w.g, 1, size(w.m)), (x, y) -> named_struct('x', x, 'y', y)), slice(w.g, 2, size(w.m)), (v, z) -> named_struct('x', v.x, 'y', v.y, 'z', z))"
    before = running("transform(r, l -> length(l.y) + length(l.x))", lambda a, b: f"{a} + {b}", 0)
    row = "named_struct('s', p + length(l.y), 'e', p + length(l.y) + length(l.x), 't', l.x" + (f", {sides}" if near else "") + ")"
    found = _let("r", pieces, f"zip_with(r, {before}, (l, p) -> {row})")
    return _let("w", f"named_struct('m', regexp_extract_all({text}, {_q(pattern)}, 0), 'g', split({text}, {_q(pattern)}, -1))", f"if(size(w.m) = 0, cast(array() as array<{_NEAR if near else _SPAN}>), {found})")


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def luhn(x: str) -> str:
    """SQL: whether the digits of x pass the Luhn test."""
    d = f"reverse({_digits(x)})"
    each = f"transform(split({d}, ''), (c, i) -> if(i % 2 = 0, cast(c as int), if(cast(c as int) > 4, 2 * cast(c as int) - 9, 2 * cast(c as int))))"
    return f"aggregate({each}, 0, (a, v) -> a + v) % 10 = 0"


def base_spans(text: str = _TEXT) -> dict[str, str]:
    """SQL of the base spans of each kind, as array<struct<s,e,t>>."""
    none = f"cast(array() as array<{_SPAN}>)"
    n = f"length({_digits('v.t')})"
    return {
        "email": f"if(instr({text}, '@') > 0, {located(text, EMAIL)}, {none})",
        "ip": f"if({text} rlike '[0-9]\\\\.[0-9]', filter({located(text, IP)}, v -> v.t rlike {_q(IP_VALID)}), {none})",
        "card": f"if({text} rlike {_q(CARD)}, filter({located(text, CARD)}, v -> {n} between 14 and 19 and {luhn('v.t')}), {none})",
        "phone": f"if(instr({text}, '+') > 0, filter({located(text, PHONE)}, v -> {n} between 10 and 15), {none})",
    }


def _candidates(text: str = _TEXT) -> str:
    """SQL: all candidates with their kinds, votes and features, as array<struct<k,s,e,v,f>>."""
    parts = []
    for kind, (pattern, needs, votes, features) in CANDIDATES.items():
        bits = ", ".join(f"cast({x} as int)" for x in features)
        voted = f"transform({located(text, pattern, near=True)}, c -> named_struct('k', '{kind}', 's', c.s, 'e', c.e, 'v', array({', '.join(votes)}), 'f', array({bits})))"
        parts.append(f"if({text} rlike {_q(needs)}, {voted}, cast(array() as array<struct<k:string,s:int,e:int,v:array<int>,f:array<int>>>))")
    return f"concat({', '.join(parts)})"


def label_model(candidates: DataFrame, rounds: int = 20, steps: int = 300) -> DataFrame:
    """(k, n, prior, w) from candidates (k, v, f): for each kind the EM prior and the classifier's weights, bias first.

    Rows: bounded by the number of kinds; the arrays that are folded over have one entry for
    each pattern of votes and features that occurs. Dawid-Skene with add-one counts, from a
    majority start; the classifier is a ridged logistic regression on the posteriors.
    """
    counts = candidates.groupBy("k", "v", "f").agg(F.count_if(F.lit(True)).alias("n"))
    by = counts.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("v", "f", "n"))).alias("p"), F.sum("n").alias("n"))
    start = "transform(p, x -> named_struct('v', x.v, 'f', concat(array(1.0D), transform(x.f, y -> cast(y as double))), 'n', cast(x.n as double), 'q', 1 / (1 + exp(-1.0 * aggregate(x.v, 0, (a, b) -> a + b) + 0.5))))"
    share = lambda y, test: "aggregate(st, 0.0D, (a, z) -> a + " + (f"if({test}, " if test else "") + "z.n * " + ("z.q" if y else "(1 - z.q)") + (", 0.0D)" if test else "") + ")"
    # One round: what each labeler's votes weigh, from all patterns, then new posteriors.
    odds = [f"array(ln({share(1, '')} + 1) - ln({share(0, '')} + 1))"]
    for i in range(LABELERS):
        odds.append("transform(array(-1, 0, 1), y -> " + " - ".join(f"ln(({share(y, f'z.v[{i}] = y')} + 1) / ({share(y, '')} + 3))" for y in (1, 0)) + ")")
    posterior = "o[0][0] + " + " + ".join(f"o[{i + 1}][x.v[{i}] + 1]" for i in range(LABELERS))
    em = f"aggregate(sequence(1, {rounds}), {start}, (st, r) -> " + _let("o", f"array({', '.join(odds)})", f"transform(st, x -> named_struct('v', x.v, 'f', x.f, 'n', x.n, 'q', 1 / (1 + exp(-({posterior})))))") + ")"
    dot = "aggregate(zip_with(w, z.f, (a, b) -> a * b), 0.0D, (a, b) -> a + b)"
    pull = f"transform(st, z -> named_struct('f', z.f, 'r', 0.5D * z.n / n * (z.q - 1 / (1 + exp(-{dot})))))"
    step = f"aggregate(sequence(1, {steps}), transform(st[0].f, x -> 0.0D), (w, i) -> aggregate({pull}, transform(w, a -> a * 0.999D), (u, z) -> zip_with(u, z.f, (a, x) -> a + z.r * x)))"
    fitted = by.withColumn("st", F.expr(em))
    return fitted.select("k", "n", F.expr("aggregate(st, 0.0D, (a, z) -> a + z.n * z.q) / n").alias("prior"), F.expr(step).alias("w"))


def _apart(cands: str, base: str) -> str:
    """SQL: the candidates that overlap none of the base spans, by start.

    In order of their starts (base first), a candidate is apart if no base span before it ends
    after its start and none after it starts before its end.
    """
    all_ = f"array_sort(concat(transform({base}, x -> named_struct('s', x.s, 'b', 0, 'e', x.e, 'c', cast(null as struct<k:string,s:int,e:int,v:array<int>,f:array<int>>))), transform(cs, x -> named_struct('s', x.s, 'b', 1, 'e', x.e, 'c', x))))"
    ended = running("transform(u, x -> if(x.b = 0, x.e, 0))", lambda a, b: f"greatest({a}, {b})", 0)
    begun = running("reverse(transform(u, x -> if(x.b = 0, x.s, 2147483647)))", lambda a, b: f"least({a}, {b})", 2147483647)
    met = f"zip_with(zip_with(u, {ended}, (x, y) -> named_struct('x', x, 'y', y)), reverse({begun}), (h, y) -> if(h.x.b = 1 and h.y <= h.x.s and y >= h.x.e, h.x.c, null))"
    kept = _let("u", all_, f"filter({met}, x -> x is not null)")
    return _let("cs", cands, f"if(size(cs) = 0, cs, {kept})")


def find_pii(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs with base and added: arrays of struct(s, o, e, k), by start, then kind as listed.

    docs needs text; columns named base or added are replaced, others stay as they are. A null text is empty; empty texts and texts without finds have empty
    arrays; equal texts have equal spans. An empty table gives none. Long texts are searched
    whole, and runs of any length need no stack.
    """
    voted = docs.select(F.coalesce("text", F.lit("")).alias(_TEXT)).select(F.explode(F.expr(_candidates())).alias("c")).select("c.k", "c.v", "c.f")
    weights = {r["k"]: r["w"] for r in label_model(voted).collect()}  # one row a kind at most
    case = "".join(f" when c.k = '{k}' then {w[0]!r}D" + "".join(f" + {x!r}D * c.f[{i}]" for i, x in enumerate(w[1:])) for k, w in sorted(weights.items()))
    score = f"(case {case} else -1.0D end)" if case else "-1.0D"
    order = lambda k: KINDS.index(k)
    base = ", ".join(f"transform({sql}, x -> named_struct('s', x.s, 'o', {order(k)}, 'e', x.e, 'k', '{k}'))" for k, sql in base_spans().items())
    at = "case c.k " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS)) + " end"
    out = docs.drop("base", "added").withColumn(_TEXT, F.coalesce("text", F.lit("")))
    out = out.withColumn("base", F.expr(f"array_sort(concat({base}))"))
    likely = f"filter({_candidates()}, c -> 1 / (1 + exp(-({score}))) >= {threshold})"
    out = out.withColumn("added", F.expr(f"array_sort(transform({_apart(likely, 'base')}, c -> named_struct('s', c.s, 'o', {at}, 'e', c.e, 'k', c.k)))"))
    return out.drop(_TEXT)


def joined(spans: str) -> str:
    """SQL: kind:start:end of each span, comma-joined."""
    return f"array_join(transform({spans}, x -> concat(x.k, ':', x.s, ':', x.e)), ',')"


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans of the rows of find_pii."""
    count = [F.expr(f"cast(size(filter(base, x -> x.k = '{k}')) as long)").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *count, F.sha2(F.expr(joined("base")), 256).alias("base_sha256"), F.expr(joined("array_sort(concat(base, added))")).alias("spans"))


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs with every span of its texts replaced by its kind in angle brackets; overlapping spans go as one, under the first's kind.

    Null texts stay null; the other columns stay as they are. Spans are replaced in about
    sqrt(spans) blocks, each over its own part of the text, so that no place of a long text is
    counted up to once a span.
    """
    found = find_pii(docs.select(F.struct(*docs.columns).alias("row_"), "text"), threshold)
    spans = "array_sort(concat(base, added))"
    # A span's place is marked 'x' if an earlier one reaches into it; p: where the last span before ends.
    marked = f"zip_with(a, {running('transform(a, x -> x.e)', lambda a, b: f'greatest({a}, {b})', 0)}, (x, p) -> named_struct('s', x.s, 'e', greatest(x.e, p), 'k', x.k, 'p', p))"
    blocks = _let("n", "cast(ceil(sqrt(size(r))) as int)", "transform(sequence(0, (size(r) - 1) div n), i -> slice(r, cast(i * n + 1 as int), n))")
    # part: the text from the end of the spans before the block to that of its last; places in it are counted from there.
    fill = "if(x.s < x.p, '', concat(substring(g, x.p - h + 1, x.s - x.p), '<', upper(x.k), '>'))"
    piece = _let("h", "k[0].p", _let("g", "substring(text, h + 1, element_at(k, -1).e - h)", f"array_join(transform(k, x -> {fill}), '')"))
    tail = "substring(text, element_at(r, -1).e + 1, length(text))"
    done = _let("a", spans, _let("r", marked, f"concat(array_join(transform({blocks}, k -> {piece}), ''), {tail})"))
    text = F.when(F.expr("size(base) + size(added) > 0"), F.expr(done)).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*[F.col("text") if c == "text" else F.col("row_")[c].alias(c) for c in docs.columns])
