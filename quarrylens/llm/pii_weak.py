"""Personal data by weak supervision.

Candidates are the base matches (email, ip, card, phone) and looser ones: written-out addresses, national phone
numbers, card-like numbers without a valid check digit, and bank account numbers.  Labellers vote yes, no or nothing on each:
a strict rule for the span's form (lengths of labels and groups, leading zeros, check digits of accounts), a gazetteer
(top-level domains, calling codes, issuer prefixes, routable networks, countries of accounts), the words around it, and its borders.  Expectation-maximisation over the counts of vote patterns estimates the
labellers' reliabilities; its posteriors train a logistic span classifier over the votes and the span's
shape.  Both work on tables bounded by the number of patterns, whatever the corpus.  Base spans stay in any case; the
classifier decides which loose candidates are added.

Everything that touches rows is a built-in function; the fits run on the driver over those bounded tables.

Defined results: null text is the empty text; no spans: zero counts, the hash of the empty string; repeated rows: repeated
results; very long texts are scanned whole; empty table: empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm._common import written
from quarrylens.llm._spans import listed, matches_where

# The base patterns (repeats made possessive where nothing is given back) and the looser ones.
BASE = ("email", "ip", "card", "phone")
LOOSE = ("address", "national", "number", "account")
KINDS = BASE + LOOSE
EMAIL = "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}"
CARD = "(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){11,18}+(?![ -]?[0-9])"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
ADDRESS = "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\\x20?[\\[(]at[\\])]\\x20?[A-Za-z0-9-]{1,64}+(?:\\x20?[\\[(]dot[\\])]\\x20?[A-Za-z0-9-]{1,64}+)++"
NATIONAL = "(?<![0-9+.)-])(?<![0-9][ -])(?:\\([0-9]{3}\\)\\x20?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![ .-]?[0-9])"
ACCOUNT = "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){3,7}(?:\\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"

# Gazetteers and context words.
DOMAINS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "app", "dev", "io", "ai", "co", "me", "tv", "cc", "eu", "us", "ca", "mx", "br", "ar", "cl", "uy", "pe", "ve", "ec", "bo", "cr", "cu",
    "uk", "ie", "de", "fr", "es", "pt", "it", "nl", "be", "lu", "ch", "at", "dk", "se", "no", "fi", "is", "ee", "lv", "lt", "pl", "cz", "sk", "hu", "ro", "bg", "gr", "hr", "si", "rs", "ua", "by", "ru", "tr", "il",
    "ae", "sa", "qa", "eg", "ma", "tn", "ng", "ke", "za", "in", "pk", "bd", "lk", "cn", "tw", "hk", "jp", "kr", "vn", "th", "my", "sg", "id", "ph", "au", "nz",
)
ACCOUNT_COUNTRIES = (
    "AD", "AE", "AL", "AT", "AZ", "BA", "BE", "BG", "BH", "BR", "BY", "CH", "CR", "CY", "CZ", "DE", "DK", "DO", "EE", "EG", "ES", "FI", "FO", "FR", "GB", "GE", "GI", "GL", "GR", "GT", "HR", "HU", "IE", "IL", "IQ",
    "IS", "IT", "JO", "KW", "KZ", "LB", "LI", "LT", "LU", "LV", "MC", "MD", "ME", "MK", "MR", "MT", "MU", "NL", "NO", "PK", "PL", "PS", "PT", "QA", "RO", "RS", "SA", "SE", "SI", "SK", "SM", "TN", "TR", "UA", "XK",
)
CALLING = "^(?:1|7|2[07]|2[1-689][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[7-9][0-9]|8[1246]|8[0578][0-9]|9[0-58]|9[679][0-9])"
CONTEXT = {
    "email": "mail|contact|write|courriel|correo|kontakt", "ip": "\\bip\\b|address|host|server|adresse", "card": "card|visa|karte|carte|tarjeta|credit|payment",
    "phone": "phone|call|tel|mobile|fax|telefon|appel", "address": "mail|contact|write|courriel|correo|kontakt", "national": "phone|call|tel|mobile|fax|telefon|appel",
    "number": "card|visa|karte|carte|tarjeta|credit|payment", "account": "iban|account|konto|compte|cuenta|bank",
}
AGAINST = "version|isbn|issn|order|invoice|build|serial|part no|page"
YES, NONE, NO = 2, 1, 0
LABELLERS = ("rule", "gazetteer", "context", "border")
KEEP = 0.5


def _digits(s: F.Column) -> F.Column:
    return F.regexp_replace(s, "[^0-9]+", "")


def luhn(digits: F.Column) -> F.Column:
    """Whether a string of digits passes the check."""

    def add(acc, i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = 2 * d
        return acc + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _small_parts(hit: F.Column) -> F.Column:
    def small(p):
        bare = F.regexp_replace(p, "^0+", "")
        return (F.length(bare) <= 3) & (F.coalesce(F.when(F.length(bare) > 0, F.substring(bare, 1, 3).cast("int")), F.lit(0)) <= 255)

    return F.forall(F.split(hit, "\\."), small)


def _raw_columns(text: F.Column) -> dict[str, F.Column]:
    at, digit = F.contains(text, F.lit("@")), text.rlike("[0-9]")
    return {
        "email": matches_where(text, at, EMAIL),
        "ip": matches_where(text, text.rlike("[0-9]\\.[0-9]++\\.[0-9]++\\.[0-9]"), IP),
        "digits": matches_where(text, digit & text.rlike(CARD), CARD),
        "phone": matches_where(text, F.contains(text, F.lit("+")), PHONE),
        "address": matches_where(text, text.rlike("[\\[(]at[\\])]"), ADDRESS),
        "national": matches_where(text, digit & text.rlike("[0-9]{3}[ .-][0-9]{4}"), NATIONAL),
        "account": matches_where(text, digit & text.rlike("[A-Z]{2}[0-9]{2}"), ACCOUNT),
    }


def _split_kinds(raw) -> dict[str, F.Column]:
    """Spans of each kind out of the raw matches."""
    many = lambda s: F.length(_digits(s["hit"]))
    inside = lambda spans, others: F.filter(spans, lambda s: ~F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))
    phone = F.filter(raw("phone"), lambda s: many(s).between(9, 15))
    return {
        "email": raw("email"),
        "ip": F.filter(raw("ip"), lambda s: _small_parts(s["hit"])),
        "card": F.filter(raw("digits"), lambda s: luhn(_digits(s["hit"]))),
        "phone": phone,
        "address": raw("address"),
        "national": inside(inside(raw("national"), raw("digits")), raw("phone")),
        "number": F.filter(raw("digits"), lambda s: ~luhn(_digits(s["hit"]))),
        "account": raw("account"),
    }


def _gazetteer(kind: str, hit: F.Column) -> F.Column:
    if kind == "email":
        return F.when(F.lower(F.regexp_extract(hit, "([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS), YES).otherwise(NO)
    if kind == "ip":
        return F.when(hit.rlike("^(?:0|10|127|169\\.254|192\\.168|2[2-5][0-9])\\."), NO).otherwise(YES)
    if kind in ("card", "number"):
        return F.when(_digits(hit).rlike("^(?:4|5[1-5]|34|37|6011|65|35)"), YES).otherwise(NO)
    if kind == "phone":
        return F.when(_digits(hit).rlike(CALLING), YES).otherwise(NO)
    if kind == "address":
        return F.when(F.lower(F.regexp_extract(hit, "([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS), YES).otherwise(NO)
    if kind == "account":
        return F.when(F.substring(hit, 1, 2).isin(*ACCOUNT_COUNTRIES), YES).otherwise(NO)
    return F.lit(NONE)


def mod97(hit: F.Column) -> F.Column:
    """Whether an account number passes its check: the first four characters last, letters as 10 to 35, 1 modulo 97."""
    solid = F.regexp_replace(hit, " ", "")
    turned = F.concat(F.substring(solid, 5, 64), F.substring(solid, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    add = lambda acc, c: ((acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97).cast("int")
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"


def _rule(kind: str, hit: F.Column) -> F.Column:
    """The vote of the strict rule of a kind on a span's form."""
    passes = lambda good: F.when(good, YES).otherwise(NO)
    if kind == "email":
        return passes(hit.rlike(f"^(?=[^@]{{1,64}}@)[A-Za-z0-9_%+-]++(?:\\.[A-Za-z0-9_%+-]++)*+@(?:{_LABEL}\\.)+[A-Za-z]{{2,24}}$"))
    if kind == "ip":
        return passes(hit.rlike("^(?!0\\.)(?:(?:0|[1-9][0-9]{0,2})(?:\\.|$)){4}$"))
    if kind == "card":
        return passes(_digits(hit).rlike("^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3[0689][0-9]{12}|6[0-9]{15}|35[0-9]{14})$") & ~hit.rlike("([0-9])\\1{7}"))
    if kind == "phone":
        return passes(hit.rlike("^\\+[1-9][0-9]{0,2}(?:[ .-]?\\(?[0-9]{1,5}\\)?)(?:[ .-]?[0-9]{2,5}){1,5}$"))
    if kind == "address":
        return passes(hit.rlike("[\\[(]dot[\\])]\\x20?[A-Za-z]{2,24}$"))
    if kind == "national":
        return passes(hit.rlike("^\\(?[2-9][0-9]{2}\\)?[ .-]*[2-9][0-9]{2}[ .-]"))
    if kind == "account":
        return passes(mod97(hit))
    return F.lit(NO)  # number: its check digit is wrong


def _judged(text: F.Column, kind: str, place: int, spans: F.Column) -> F.Column:
    """Spans with their votes and shape."""

    def one(s):
        before = F.substring(text, F.greatest(s["start"] - 39, F.lit(1)).cast("int"), F.least(s["start"], F.lit(40)).cast("int"))
        after = F.substring(text, (s["end"] + 1).cast("int"), F.lit(1))
        context = F.when(F.lower(before).rlike(CONTEXT[kind]), YES).when(F.lower(before).rlike(AGAINST), NO).otherwise(NONE)
        border = F.when(before.rlike("[\\p{L}\\p{N}_]$") | after.rlike("^[\\p{L}\\p{N}_]"), NO).otherwise(YES)
        vote = _rule(kind, s["hit"]) + 3 * _gazetteer(kind, s["hit"]) + 9 * context + 27 * border
        length = F.least(F.floor(F.length(s["hit"]) / 8), F.lit(5))
        broken = F.when(s["hit"].rlike("[ ()]"), 1).otherwise(0)
        return F.struct(
            s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind"), vote.cast("int").alias("vote"), (length * 2 + broken).cast("int").alias("shape")
        )

    return F.transform(spans, one)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and all candidate spans of docs(doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"))
    raw = base.select("doc_id", "_text", *[c.alias(f"_raw_{k}") for k, c in _raw_columns(F.col("_text")).items()])
    split = raw.select("doc_id", "_text", *[c.alias(f"_of_{k}") for k, c in _split_kinds(lambda k: F.col(f"_raw_{k}")).items()])
    return split.select("doc_id", F.concat(*[_judged(F.col("_text"), k, i, F.col(f"_of_{k}")) for i, k in enumerate(KINDS)]).alias("found"))


def em(votes: np.ndarray, counts: np.ndarray, rounds: int = 60):
    """Posterior of each vote row and each labeller's P(vote | class); two classes, abstaining carries no evidence."""
    prior, k = 0.7, votes.shape[1]
    rate = np.empty((k, 2, 3))
    rate[:, 0], rate[:, 1] = [0.7, 1.0, 0.3], [0.2, 1.0, 0.8]
    post = np.zeros((len(votes), 2))
    for _ in range(rounds):
        log = np.tile(np.log([1 - prior, prior]), (len(votes), 1))
        for j in range(k):
            log += np.log(rate[j][:, votes[:, j]]).T
        post = np.exp(log - log.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        weight = post * counts[:, None]
        prior = min(0.95, max(0.05, weight[:, 1].sum() / max(weight.sum(), 1e-9)))
        for j in range(k):
            for c in (0, 1):
                # pseudo-counts hold a labeller on its side of chance while there is little evidence
                no = weight[votes[:, j] == NO, c].sum() + (7 if c == 0 else 2)
                yes = weight[votes[:, j] == YES, c].sum() + (3 if c == 0 else 8)
                rate[j, c] = [no / (no + yes), 1.0, yes / (no + yes)]
    return post[:, 1], prior, rate


def train(kind: np.ndarray, vote: np.ndarray, shape: np.ndarray, counts: np.ndarray) -> dict[str, dict[int, float]]:
    """Weights of a logistic span classifier for each kind, vote of a labeller, and shape; fitted on counted rows."""
    votes = np.column_stack([(vote // 3**j) % 3 for j in range(len(LABELLERS))])
    target, _, _ = em(votes, counts)
    blocks = [np.eye(len(KINDS))[kind], *[np.eye(3)[votes[:, j]] for j in range(len(LABELLERS))], np.eye(12)[shape]]
    x = np.hstack([np.ones((len(kind), 1)), *blocks])
    share = np.sqrt(counts) / np.sqrt(counts).sum()
    w = np.zeros(x.shape[1])
    for _ in range(2000):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 4.0 * (x.T @ (share * (p - target)) + 1e-4 * w)
    ends = np.cumsum([1, *[b.shape[1] for b in blocks]])
    parts = [w[a:b] for a, b in zip(ends[:-1], ends[1:])]
    by_vote = {v: float(sum(parts[1 + j][(v // 3**j) % 3] for j in range(len(LABELLERS)))) for v in range(3 ** len(LABELLERS))}
    return {"kind": {k: float(parts[0][k] + w[0]) for k in range(len(KINDS))}, "vote": by_vote, "shape": {s: float(parts[-1][s]) for s in range(12)}}


def _weight(table: dict[int, float], key: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(table[k]) for k in range(len(table))]), (key + 1).cast("int"))


def pii_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of docs(doc_id, text)."""
    found = written(candidates(docs), "op4-candidates")
    each = found.select(F.explode("found").alias("s")).groupBy("s.place", "s.vote", "s.shape").agg(F.count(F.lit(1)).alias("n"))
    rows = sorted(each.collect())  # kinds x votes x shapes: 7776 rows at most
    spans = F.col("found")
    is_base = lambda s: s["place"] < len(BASE)
    if rows:
        kind, vote, shape, n = (np.array([r[k] for r in rows]) for k in range(4))
        weights = train(kind, vote, shape, n.astype(float))
        logit = lambda s: _weight(weights["kind"], s["place"]) + _weight(weights["vote"], s["vote"]) + _weight(weights["shape"], s["shape"])
        bound = float(np.log(KEEP / (1 - KEEP)))
        spans = F.filter(spans, lambda s: is_base(s) | (logit(s) >= bound))
    kept = found.select("doc_id", F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return kept.select("doc_id", *[of(k) for k in BASE], F.sha2(listed(F.filter("spans", is_base)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
