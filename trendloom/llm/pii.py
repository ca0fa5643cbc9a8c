"""Personal data by weak supervision (native SQL).

Regex labelers propose candidate spans.  Six labelers vote for, against or not at
all on each: strict shape, gazetteer (given names, street words, account countries with their check digits, and
known structures inside the span), cues to the left, words to the left that
speak of versions and amounts, what follows to the right, variety of characters, and closed lists.  Candidates are generated
loosely (any two capitalised words, say), so that labelers disagree and the classifier decides.
Expectation-maximisation over the table of vote patterns (bounded by labelers and features,
whatever the corpus) estimates how reliable each labeler is and how likely each
candidate; priors worth ``strength`` candidates keep small corpora sane.  These soft
labels then train a naive-Bayes span classifier on span features and votes.  Base spans
(email, ip, card, phone by fixed rules) always stay; the classifier decides
about added ones (names after a title, national phone and id numbers, secrets, access keys, persons,
addresses, dates of birth, account numbers).

Defined cases: null text is empty; empty texts have no spans and the digest of
the empty string; repeated rows keep a row each; an empty table gives no rows; very long texts are searched whole,
positions add up in chunks; ties of equal candidates share a pattern and so a score; extra columns are ignored
(``redact`` keeps them).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables
from .gazetteers import GIVEN_NAMES, IBAN_COUNTRIES, STREET_ENDINGS, STREETS, STREETS_BEFORE

# The base patterns, with possessive repeats so that no text can overflow the matcher's stack.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
EXTRA = {
    "name": r"\b(?:Mrs|Mr|Ms|Dr|Prof|Herr|Frau|Sra|Sr|Mme)\.? [A-ZÀ-Þ][\wÀ-ɏ'-]{1,30}(?: [A-ZÀ-Þ][\wÀ-ɏ'-]{1,30})?",
    "number": r"(?<!\+[\x20().0-9-]{1,30})(?<![\w.+-])(?:\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])",
    "secret": r"(?i)\b(?:api[_-]?key|access[_-]?key|auth|bearer|token|secret|password|passwd|pwd)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_/+.-]{8,200}",
    "key": r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,80}|sk-[A-Za-z0-9]{20,80}|xox[abps]-[A-Za-z0-9-]{10,80})(?![A-Za-z0-9_-])|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
    "person": rf"(?<![\p{{L}}\p{{N}}_-])(?![A-ZÀ-Þ]\S* (?:{'|'.join(GIVEN_NAMES)}) [A-ZÀ-Þ])" + r"[A-ZÀ-Þ][a-zà-ÿ]{1,20}(?: [A-ZÀ-Þ]\.)? [A-ZÀ-Þ][a-zà-ÿ'-]{1,20}(?![\p{L}\p{N}_])",
    "address": rf"(?<![\w.])[0-9]{{1,5}} (?:[A-ZÀ-Þ][a-zà-ÿ]{{1,20}} ){{1,3}}(?:{'|'.join(STREETS)})(?!\w)|(?<!\w)[A-ZÀ-Þ][a-zà-ÿ]{{1,20}}(?:{'|'.join(STREET_ENDINGS)})\.? [0-9]{{1,4}}(?!\w)|(?<![\w.])[0-9]{{1,4}},? (?:{'|'.join(STREETS_BEFORE)}|rue|calle)(?: (?:de|du|des|la|del|las|los))* [A-ZÀ-Þ][a-zà-ÿ]{{1,20}}(?!\w)",
    "birth": r"(?i)(?<!\w)(?:born|birthday|date of birth|dob|geboren|née?|nacid[oa])\W{1,3}(?:(?:on|am|el|le|the|is)\W)?[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}(?![\w-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
KINDS = [*BASE, *EXTRA]
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
# Labelers: strict shapes by kind, structures by kind, and words of the context.
SHAPES = {
    "email": r"^[^.].*\.[A-Za-z]{2,24}$", "ip": r"^[1-9]", "card": r"^[3-6]", "phone": r"^\+[1-9][^.]*$", "name": r"[a-zà-ɏ]$",
    "number": r"^(?:\(?[2-9][0-9]{2}\)?[ .-][2-9]|(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000))", "secret": r"(?i)[=:].*(?:[0-9].*[a-z]|[a-z].*[0-9])", "key": r".",
    "person": r"^(?!(\S+) \1$)\S{3,} (?:\S+ )?\S{3,}$", "address": r"[1-9]", "birth": r"(?:19|20)[0-9]{2}", "iban": r"^(?=(?:.*[0-9]){10})[A-Z0-9 ]{15,42}$",
}
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk)$|@.*mail", "ip": r"^(?:10|127|169\.254|172|192\.168)\.", "card": r"^(?:4|5[1-5]|3[47]|6011)",
    "phone": r"^\+(?:1|3[0-9]|4[0-9]|5[0-9]|6[0-6]|7|8[0-9]|9[0-9])\D", "name": r"^(?:Mrs|Mr|Ms|Dr|Prof|Herr|Frau|Mme)\b", "number": r"555|^[0-9]{3}-[0-9]{2}-", "secret": r"(?i)key|token|secret|passw", "key": r"^(?:AKIA|ASIA|gh|sk|xox|-----)",
    "person": rf"^(?:{'|'.join(GIVEN_NAMES)}) ", "address": r".", "birth": r"^(?i:born|birth|date|dob|geboren|n)", "iban": rf"^(?:{'|'.join(IBAN_COUNTRIES)})",
}
# Kinds whose gazetteer is a closed list: not to be in it speaks against a candidate.
CLOSED = ["person", "iban"]
CUES = r"(?i)(?:mail|contact|call|phone|tel|fax|reach|write|card|visa|pay|account|ip|host|server|login|user|key|token|password|name|dear|ssn|social|from|to|by)\W{0,4}\w{0,12}\W{0,4}$"
AGAINST = r"(?i)(?:version|release|section|chapter|figure|table|page|isbn|doi|rfc|part|no|nr|v)\.?\s{0,3}$"
CONTEXT = 40
CHUNK = 256


def _digits(x):
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x):
    d = _digits(x)
    n = F.length(d)
    one = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    twice = lambda i: F.when(one(i) * 2 > 9, one(i) * 2 - 9).otherwise(one(i) * 2)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when((n - i) % 2 == 0, one(i)).otherwise(twice(i)))
    return n.between(16, 19) & (total % 10 == 0)


def valid(kind: str, x):
    if kind == "ip":
        return x.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(x)).between(16, 19) & _luhn(x)
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


def _spans(text: str, kind: str):
    """Array of (kind, start, end, span, before, after): leftmost non-overlapping matches that are valid.

    The pieces between matches come from ``split``; running lengths of pieces
    and matches give positions in code points: within chunks first, then by chunk, so
    that the work stays near linear in the matches of a text.
    """
    pattern = BASE.get(kind) or EXTRA[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<kind:int,start:int,end:int,span:string,before:string,after:string>>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc, p):
        start = acc["at"] + F.char_length(p["gap"])
        end = start + F.char_length(p["span"])
        one = F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), end.alias("end"), p["span"].alias("span"), F.right(p["gap"], F.lit(CONTEXT)).alias("before"), F.coalesce(F.left(p["next"], F.lit(8)), F.lit("")).alias("after"))
        return F.when(p["span"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out")))

    def placed(gaps):
        parts = F.arrays_zip(gaps.alias("gap"), found.alias("span"), F.slice(gaps, 2, F.size(gaps)).alias("next"))
        return F.transform(F.array(parts), lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / CHUNK).cast("int")), lambda c: F.aggregate(F.slice(p, c * CHUNK + 1, F.lit(CHUNK)), zero, step)))[0]

    def shifted(chunks):
        bases = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(chunks, bases, lambda c, b: F.transform(c["out"], lambda s: s.withField("start", s["start"] + b).withField("end", s["end"] + b))))

    once = F.transform(F.array(F.split(text, pattern, -1)), lambda g: placed(g))
    spans = F.transform(once, lambda c: shifted(c))[0]
    probe = {"email": "@", "phone": r"\+[0-9]"}.get(kind, pattern)
    return F.when(F.col(text).rlike(probe), F.filter(spans, lambda s: valid(kind, s["span"]))).otherwise(empty)


def candidates(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id, spans`` and the columns to keep: every candidate of every kind in the whole text."""
    df = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("_text"))
    return df.select("doc_id", *keep, F.concat(*[_spans("_text", k) for k in KINDS]).alias("spans"))


def _account(x):
    """Check digits of an account number: letters count 10 to 35, the first four characters come last, the rest of 97 is 1."""
    c = F.regexp_replace(x, " ", "")
    turned = F.concat(F.substring(c, F.lit(5), F.length(c)), F.left(c, F.lit(4)))
    value = lambda ch: F.when(ch.rlike("[0-9]"), F.ascii(ch) - 48).otherwise(F.ascii(ch) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, ch: F.when(ch == "", acc).otherwise((acc * F.when(value(ch) > 9, 100).otherwise(10) + value(ch)) % 97)) == 1


def _listed(s):
    """Vote of the closed lists: in the list (an account also by its check digits), not in it, or no such kind."""
    found = _by_kind(s, GAZETTEER) & F.when(s["kind"] == KINDS.index("iban"), _account(s["span"])).otherwise(F.lit(True))
    return F.when(~s["kind"].isin([KINDS.index(k) for k in CLOSED]), 1).when(found, 2).otherwise(0)


def _by_kind(s, patterns: dict):
    out = F.lit(False)
    for i, k in enumerate(KINDS):
        out = F.when(s["kind"] == i, s["span"].rlike(patterns[k])).otherwise(out)
    return out


def votes(s) -> list:
    """Labelers: 2 for, 0 against, 1 no vote."""
    either = lambda x: F.when(x, 2).otherwise(0)
    only_for = lambda x: F.when(x, 2).otherwise(1)
    only_against = lambda x: F.when(x, 0).otherwise(1)
    return [either(_by_kind(s, SHAPES)), only_for(_by_kind(s, GAZETTEER) & ~s["kind"].isin([KINDS.index(k) for k in CLOSED])), only_for(s["before"].rlike(CUES)), only_against(s["before"].rlike(AGAINST)),
            F.when(s["after"].rlike(r"^(?:[\s.,;:!?)\"'\]>]|$)"), 2).when(s["after"].rlike(r"^[\w@/-]"), 0).otherwise(1), only_against(s["span"].rlike(r"([0-9A-Za-z])\1{6}")), _listed(s)]


def features(s) -> list:
    return [s["kind"], F.least(F.floor(F.length(s["span"]) / 4), F.lit(9)).cast("int"), F.least(F.length(_digits(s["span"])), F.lit(20)).cast("int"), (s["start"] == 0).cast("int"), F.when(s["before"].rlike(r"\s$"), 1).otherwise(0)]


LABELERS = 7
# How labelers are expected to vote (against, none, for) on a true and on a false candidate.
TRUE_VOTES, FALSE_VOTES, TRUE_SHARE = [(0.05, 0.25, 0.7)] * 6 + [(0.02, 0.28, 0.7)], [(0.4, 0.4, 0.2)] * 6 + [(0.7, 0.28, 0.02)], 0.6


def estimate(patterns: list[tuple], rounds: int = 25, strength: float = 30.0) -> tuple[list[float], list, list, float]:
    """EM over (votes, features, count) rows: probability of each row, vote shares per labeler for true and for false ones, share of true ones."""
    true, false, share = [list(v) for v in TRUE_VOTES], [list(v) for v in FALSE_VOTES], TRUE_SHARE
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for v, _f, _n in patterns:
            p, q = share, 1 - share
            for j, x in enumerate(v):
                p *= true[j][x]
                q *= false[j][x]
            post.append(p / (p + q))
        n1 = sum(w * n for w, (_, _, n) in zip(post, patterns))
        n0 = sum((1 - w) * n for w, (_, _, n) in zip(post, patterns))
        share = (n1 + strength * TRUE_SHARE) / (n1 + n0 + strength)
        for j in range(LABELERS):
            for x in range(3):
                a = sum(w * n for w, (v, _, n) in zip(post, patterns) if v[j] == x)
                b = sum((1 - w) * n for w, (v, _, n) in zip(post, patterns) if v[j] == x)
                true[j][x] = (a + strength * TRUE_VOTES[j][x]) / (n1 + strength)
                false[j][x] = (b + strength * FALSE_VOTES[j][x]) / (n0 + strength)
    return post, true, false, share


def learn(patterns: list[tuple], rounds: int = 25, strength: float = 30.0) -> list[dict]:
    """Naive-Bayes log odds by feature value, trained on EM's soft labels; votes start from EM's shares, features from none."""
    post, true, false, share = estimate(patterns, rounds, strength)
    total1 = sum(w * n for w, (_, _, n) in zip(post, patterns))
    total0 = sum((1 - w) * n for w, (_, _, n) in zip(post, patterns))
    tables: list[dict] = [{"prior": math.log(share / (1 - share))}]
    width = len(patterns[0][1]) if patterns else 0
    for j in range(width):
        counts: dict = {}
        for w, (_, f, n) in zip(post, patterns):
            c = counts.setdefault(f[j], [0.0, 0.0])
            c[0] += w * n
            c[1] += (1 - w) * n
        # A value starts at the odds of the whole: rare values say little.
        base = (total1 + 1) / (total1 + total0 + 2)
        tables.append({x: math.log((a + strength * base) / (total1 + strength * base)) - math.log((b + strength * (1 - base)) / (total0 + strength * (1 - base))) for x, (a, b) in counts.items()})
    return tables + [{x: math.log(true[j][x] / false[j][x]) for x in range(3)} for j in range(LABELERS)]


def find(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id``, the columns to keep, ``found``: spans with kind, start, end and score; base spans are kept whatever their score.

    Candidates are written once; what the driver sees is the table of vote patterns.
    """
    cand = Tables(docs.sparkSession).write(candidates(docs, *keep), "candidates")
    flat = cand.select(F.explode("spans").alias("s"))
    joint = flat.select(F.array(*votes(F.col("s"))).alias("v"), F.array(*features(F.col("s"))).alias("f")).groupBy("v", "f").count()
    patterns = sorted((tuple(r["v"]), tuple(r["f"]), r["count"]) for r in joint.collect())
    model = learn(patterns)

    def score(s):
        z = F.lit(model[0]["prior"])
        for column, table in zip(features(s) + votes(s), model[1:]):
            m = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])
            z = z + F.coalesce(F.try_element_at(m, column), F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    if not patterns:
        score = lambda s: F.lit(0.0)
    scored = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score(s).alias("score")))
    kept = F.filter(scored, lambda s: (s["kind"] < len(BASE)) | (s["score"] >= 0.5))
    return cand.select("doc_id", *keep, kept.alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans, their SHA-256, and all spans as text."""
    names = F.array(*[F.lit(k) for k in KINDS])
    write = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    n = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *[n(k) for k in range(len(BASE))], F.sha2(write(base), 256).alias("base_sha256"), write(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"))


def _reach(order: str) -> "F.Column":
    """Greatest end of the spans before each, in chunks as in ``_spans``."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    count = F.greatest(F.lit(0), F.floor((F.size(order) - 1) / CHUNK).cast("int"))
    longer = lambda acc, end: F.struct(F.greatest(acc["at"], end).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    chunks = F.transform(F.sequence(F.lit(0), count), lambda c: F.aggregate(F.slice(order, c * CHUNK + 1, F.lit(CHUNK)), zero, lambda acc, s: longer(acc, s["end"])))

    def joined(cs):
        bases = F.aggregate(cs, zero, lambda acc, c: longer(acc, c["at"]), lambda acc: acc["out"])
        return F.flatten(F.zip_with(cs, bases, lambda c, b: F.transform(c["out"], lambda x: F.greatest(x, b))))

    return F.transform(F.array(chunks), joined)[0]


def redact(docs: DataFrame) -> DataFrame:
    """Documents with every found span replaced by ``<kind>``; other columns stay."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    packed = docs.select("doc_id", "text", F.struct(*rest).alias("_rest")) if rest else docs.select("doc_id", "text")
    cand_docs = packed.withColumn("doc_id", F.struct(*[c for c in packed.columns if c != "text"], (F.col("text").isNull()).alias("_null")))
    f = find(cand_docs, "text").withColumn("text", F.coalesce("text", F.lit("")))
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    order = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    ordered = f.select("doc_id", "text", "found", order.alias("order"))
    ordered = ordered.withColumn("reach", _reach("order"))
    # A span that begins inside an earlier one adds no mark of its own.
    pieces = F.zip_with("order", "reach", lambda s, r: F.concat(F.substring("text", r + 1, F.greatest(F.lit(0), s["start"] - r)), F.when(s["start"] >= r, F.get(names, s["kind"])).otherwise(F.lit(""))))
    last = F.coalesce(F.array_max(F.transform("order", lambda s: s["end"])), F.lit(0))
    joined = F.concat(F.array_join(pieces, ""), F.substring("text", last + 1, F.char_length("text") - last))
    text = F.when(F.col("doc_id._null"), F.lit(None)).when(F.size("found") == 0, F.col("text")).otherwise(joined)
    out = ordered.select(F.col("doc_id.doc_id").alias("doc_id"), text.alias("text"), *[F.col(f"doc_id._rest.{c}").alias(c) for c in rest])
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)
