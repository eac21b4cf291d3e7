"""Masking of personal data as native expressions, without user-defined functions but where noted.

``sync_*`` are the fixed strategies of a table copy: they know no seed.  ``mask_*`` are the
configurable ones.  Null stays null everywhere.  Seeded choices hash ``seed:value``: the same seed and value
give the same result in any table, so masked keys still join."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.hashing import canonical, digest, hmac, number, pick, seeded

GIVEN = ["Ada", "Bela", "Cleo", "Dario", "Edda", "Finn", "Gesa", "Hugo", "Ines", "Jonas", "Kira", "Levi", "Mina", "Nils", "Olga", "Piet", "Rhea", "Sven", "Tilda", "Ugo", "Vera", "Wim", "Yara", "Zeno"]
FAMILY = ["Abendroth", "Birkholz", "Calder", "Dornfeld", "Eschen", "Falkner", "Gorwitz", "Hollander", "Imhof", "Juntunen", "Kestrel", "Lindqvist", "Marlowe", "Norrby", "Ostrow", "Pellerin", "Quandt", "Rowan", "Sorley", "Thorne", "Ulbrich", "Varga", "Wexler", "Zander"]
STREETS = ["Alder Row", "Birch Lane", "Canal Walk", "Drift Street", "Elm Rise", "Ferry Road", "Gate Close", "Harbour Way"]
CITIES = ["Aldermere", "Brackwater", "Coldstream", "Dunmore", "Eastwick", "Fenbridge", "Glenrock", "Hartwell"]
STATES = ["AB", "CD", "EF", "GH", "JK", "LM", "NP", "QR"]


def _once(c: Column, f) -> Column:
    """``f`` of ``c``, which is worked out once a row, not wherever ``f`` names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


# strategies of a table copy


def sync_email(c: Column) -> Column:
    return F.concat(F.lit("user_"), F.substring(digest(canonical(c)), 1, 8), F.lit("@example.com"))


def sync_phone(c: Column, seed: object | None = 0) -> Column:
    """With a seed, whichever: by hash, without leading zeros.  Without: four random digits."""
    if seed is None:
        return F.when(c.isNotNull(), F.concat(F.lit("+1-555-"), (F.floor(F.rand() * 9000) + 1000).cast("string")))
    return F.concat(F.lit("+1-555-"), (number(digest(canonical(c))) % 10000).cast("string"))


def sync_name(c: Column) -> Column:
    return F.concat(F.lit("User "), F.upper(F.substring(digest(canonical(c)), 1, 4)))


def sync_redact(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit("[REDACTED]"))


def sync_hash(c: Column) -> Column:
    return F.substring(digest(canonical(c)), 1, 16)


# configurable strategies


def _unless_empty(trimmed: Column, masked: Column) -> Column:
    return F.when(trimmed == "", F.lit("")).otherwise(masked)


def mask_email(c: Column, seed: object = 0, length: int = 8, keep_domain: bool = False, form: str = "user_{hash}@example.com") -> Column:
    """``form`` with the hash of the trimmed value; ``keep_domain`` keeps what follows the first @."""
    t = F.trim(canonical(c))
    before, _, after = form.partition("{hash}")
    h = F.substring(seeded(t, seed), 1, length)
    if keep_domain:
        domain = F.regexp_extract(t, "^[^@]*@(.*)$", 1)
        local = before if "@" not in before else before.split("@")[0]
        return _unless_empty(t, F.concat(F.lit(local), h, F.lit("@"), F.when(domain == "", F.lit("example.com")).otherwise(domain)))
    return _unless_empty(t, F.concat(F.lit(before), h, F.lit(after)))


def mask_phone(c: Column, seed: object = 0) -> Column:
    t = F.trim(canonical(c))
    return _unless_empty(t, F.concat(F.lit("+1-555-"), F.lpad((number(seeded(t, seed)) % 10000).cast("string"), 4, "0")))


def mask_hash(c: Column, seed: object = 0, secret: str = "", algorithm: str = "sha256", length: int | None = None, prefix: str = "") -> Column:
    """HMAC under seed and secret, cut to ``length``, after ``prefix``; an empty value stays empty."""
    h = hmac(c, f"{seed}{secret}".encode(), algorithm)
    h = F.substring(h, 1, length) if length else h
    return F.when(canonical(c) == "", F.lit("")).otherwise(F.concat(F.lit(prefix), h))


def mask_salted(c: Column, salt: str, seed: object = 0, algorithm: str = "sha256", keyed: bool = True, length: int | None = None) -> Column:
    """HMAC under seed and salt, or the digest of ``salt:value``.  BLAKE2b, which Spark lacks, in Arrow batches."""
    if algorithm == "blake2b":
        import hashlib

        key = f"{seed}{salt}".encode()[:64]

        @F.pandas_udf("string")
        def h_(s: pd.Series) -> pd.Series:
            one = (lambda v: hashlib.blake2b(v.encode(), key=key)) if keyed else (lambda v: hashlib.blake2b(f"{salt}:{v}".encode()))
            return s.map(lambda v: None if v is None else one(v).hexdigest())

        h = h_(canonical(c))
    else:
        h = hmac(c, f"{seed}{salt}".encode(), algorithm) if keyed else digest(F.concat(F.lit(f"{salt}:"), canonical(c)), algorithm)
    h = F.substring(h, 1, length) if length else h
    return F.when(canonical(c) == "", F.lit("")).otherwise(h)


def mask_redact(c: Column, replacement: str = "[REDACTED]") -> Column:
    return F.when(c.isNotNull(), F.lit(replacement))


def mask_preserve(c: Column) -> Column:
    return c


def _as_in(original: Column, new: Column) -> Column:
    first = F.substring(original, 1, 1)
    return F.when((first == F.lower(first)) & (first != F.upper(first)), F.lower(new)).otherwise(new)


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _letter(digest: Column) -> Column:
    n = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % len(_ALPHABET)
    return F.substring(F.lit(_ALPHABET), (n + 1).cast("int"), F.lit(1))


def mask_name(c: Column, seed: object = 0, style: str = "full") -> Column:
    """``full``: a given and a family name by hash, small where the original starts small; ``initials``;
    ``random``: letters and digits by hash, as long as the trimmed value.  Blank values stay."""
    t = F.trim(canonical(c))
    if style == "full":
        new = F.concat_ws(" ", _as_in(t, pick(t, seed, GIVEN)), _as_in(F.element_at(F.split(t, r"\s+"), -1), pick(t, seed, FAMILY, ":family")))
    elif style == "initials":
        new = F.concat(F.array_join(F.transform(F.split(t, r"\s+"), lambda w: F.upper(F.substring(w, 1, 1))), "."), F.lit("."))
    elif style == "random":
        new = F.array_join(F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: _letter(F.sha2(F.concat(F.lit(f"{seed}:"), t, F.lit(":"), i.cast("string")), 256))), "")
    else:
        raise ValueError(f"unknown name style: {style}")
    return F.when(t.isNull(), F.lit(None)).when(t == "", canonical(c)).otherwise(new)


def mask_date(c: Column, seed: object = 0, keep: str = "none", jitter_days: int = 30) -> Column:
    """A date that keeps the ``year``, the ``month`` (and year), or is moved by up to ``jitter_days``."""
    d, n = c.cast("date"), number(seeded(c.cast("date"), seed))
    if keep == "year":
        return F.make_date(F.year(d), (1 + n % 12).cast("int"), (1 + F.floor(n / 12) % 28).cast("int"))
    if keep == "month":
        return F.make_date(F.year(d), F.month(d), (1 + n % 28).cast("int"))
    return F.date_add(d, (n % (2 * jitter_days + 1) - jitter_days).cast("int"))


DATE_FORMS = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"), (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"),
    (r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"), (r"^\d{2}\.\d{2}\.\d{4}$", "dd.MM.yyyy"), (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"), (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^[A-Z][a-z]{2,8} \d{2}, \d{4}$", "MMMM dd, yyyy"), (r"^\d{2} [A-Z][a-z]{2} \d{4}$", "dd MMM yyyy"),
)


def mask_date_text(c: Column, seed: object = 0, keep: str = "none", jitter_days: int = 30, output_format: str | None = None) -> Column:
    """A date in text, in the first form that it has, masked and written in that form or in ``output_format``; other
    text stays."""
    t = F.trim(canonical(c))
    out = None
    for pattern, form in DATE_FORMS:
        parsed = F.try_to_timestamp(t, F.lit(form))
        new = F.date_format(mask_date(parsed, seed, keep, jitter_days), output_format or form)
        hit = t.rlike(pattern) & parsed.isNotNull()
        out = F.when(hit, new) if out is None else out.when(hit, new)
    return out.otherwise(canonical(c))


def mask_address(c: Column, seed: object = 0, preserve: tuple = ("city", "country")) -> Column:
    """A comma-separated street, city, state, postcode and country, part by part; each part hashes its
    own value, so different streets get different ones.  A single part is replaced whole."""
    t = canonical(c)
    parts = F.transform(F.split(t, ","), lambda x: F.trim(x))
    at = lambda i: F.try_element_at(parts, F.lit(i))
    street = F.concat((1 + number(seeded(at(1), seed), 9, 4) % 999).cast("string"), F.lit(" "), pick(at(1), seed, STREETS))
    made = {
        "street": (1, street), "city": (2, pick(at(2), seed, CITIES)), "state": (3, pick(at(3), seed, STATES)),
        "zip": (4, F.lpad((number(seeded(at(4), seed)) % 100000).cast("string"), 5, "0")), "country": (5, at(5)),
    }
    out = [at(i) if name in preserve else F.when(at(i).isNotNull(), new) for name, (i, new) in made.items()]
    whole = F.concat(street, F.lit(", "), pick(t, seed, CITIES))
    return F.when(t.isNull(), F.lit(None)).when(F.trim(t) == "", t).when(F.size(parts) < 2, whole).otherwise(F.concat_ws(", ", *out))


def mask_address_json(c: Column, seed: object = 0, preserve: tuple = ("city", "country")) -> Column:
    """A JSON object of street, city, state, zip and country, field by field; other fields stay, other text too."""
    j = F.from_json(canonical(c), "map<string,string>")

    def field(k, v):
        new = F.when(k == "street", F.concat((1 + number(seeded(v, seed), 9, 4) % 999).cast("string"), F.lit(" "), pick(v, seed, STREETS)))
        new = new.when(k == "city", pick(v, seed, CITIES)).when(k == "state", pick(v, seed, STATES))
        new = new.when(k == "zip", F.lpad((number(seeded(v, seed)) % 100000).cast("string"), 5, "0"))
        return F.when(k.isin(*preserve) | v.isNull(), v).otherwise(F.coalesce(new, v))

    return F.when(F.size(j) > 0, F.to_json(F.transform_values(j, field))).otherwise(canonical(c))


def masking_quality(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """(column_name, n_rows, null_changed, unchanged, split, merged) of columns and their masked forms, column ->
    masked column: nulls that appeared or went, values that stayed as they were, originals with more than
    one form, and forms that stand for more than one original."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("a"), F.col(m).cast("string").alias("b")) for c, m in pairs.items()])).alias("r")).select("r.*")
    by = rows.groupBy("column_name", "a", "b").agg(F.count("*").alias("n"))
    facts = by.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("a").isNull() != F.col("b").isNull(), F.col("n")).otherwise(0)).alias("null_changed"),
        F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("unchanged"))
    many = lambda k, of: by.filter("a IS NOT NULL AND b IS NOT NULL").groupBy("column_name", k).agg(F.count("*").alias("k")).groupBy("column_name").agg(F.count_if(F.col("k") > 1).alias(of))
    out = facts.join(many("a", "split"), "column_name", "left").join(many("b", "merged"), "column_name", "left")
    return out.select("column_name", "n_rows", "null_changed", "unchanged", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("split", "merged")])


def card_digits(c: Column) -> Column:
    return F.regexp_replace(canonical(c), "[ -]", "")


def luhn_valid(c: Column) -> Column:
    d = card_digits(c)
    return F.when(c.isNotNull(), F.when(d.rlike("^[0-9]{13,19}$"), F.call_function("luhn_check", d)).otherwise(F.lit(False)))


def card_type(c: Column) -> Column:
    d, n = card_digits(c), F.length(card_digits(c))
    return (
        F.when(n.isin(13, 16, 19) & d.startswith("4"), "visa")
        .when((n == 16) & d.rlike("^(5[1-5]|2[2-7])"), "mastercard")
        .when((n == 15) & d.rlike("^3[47]"), "amex")
        .when((n == 16) & d.rlike("^(6011|65)"), "discover")
        .when((n == 14) & d.rlike("^3[068]"), "diners")
        .when(c.isNotNull(), "unknown")
    )


def mask_card(c: Column, seed: object = 0, keep: str = "last4") -> Column:
    """A number of the same length and separators with a valid check digit, keeping all ``last4`` digits,
    the ``bin`` (first six) or none.  What isn't a card number keeps its last four characters only.

    With ``last4`` the digit before those is the one that makes the number valid."""
    d, n = card_digits(c), F.length(card_digits(c))
    h = seeded(d, seed)
    body = F.concat(*[(number(h, 1 + 3 * i, 3) % 10).cast("string") for i in range(15)])
    tries = lambda make: F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: make(x.cast("string"))), lambda s: F.call_function("luhn_check", s)), 1)
    if keep == "last4":
        make = lambda b, x: F.concat(F.substr(b, F.lit(1), n - 5), x, F.substr(d, n - 3))
    elif keep == "bin":
        make = lambda b, x: F.concat(F.substring(d, 1, 6), F.substr(b, F.lit(1), n - 7), x)
    else:
        make = lambda b, x: F.concat(F.substr(b, F.lit(1), n - 1), x)
    new = _once(body, lambda b: tries(lambda x: make(b, x)))
    chars = F.split(canonical(c), "")
    # digits of the new number, one by one, where the old ones were
    placed = _once(new, lambda v: F.aggregate(chars, F.lit(""), lambda acc, ch: F.when(ch.rlike("[0-9]"), F.concat(acc, F.substr(v, F.length(F.regexp_replace(acc, "[^0-9]", "")) + 1, F.lit(1)))).otherwise(F.concat(acc, ch))))
    rest = F.concat(F.repeat(F.lit("*"), F.greatest(F.length(canonical(c)) - 4, F.lit(0))), F.substr(canonical(c), F.greatest(F.length(canonical(c)) - 3, F.lit(1))))
    return F.when(d.rlike("^[0-9]{13,19}$"), F.when(canonical(c) == d, new).otherwise(placed)).otherwise(rest)


def mask_ip(c: Column, seed: object = 0, subnet_bits: int = 8, mask_localhost: bool = False) -> Column:
    """IPv4, with or without a prefix length: the first ``subnet_bits`` stay, the others come from the
    hash (beyond a prefix length they are zero).  127.0.0.1 and what isn't an address stay.  IPv6 in Arrow batches."""
    octet = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    form = rf"^{octet}\.{octet}\.{octet}\.{octet}(/([0-9]|[12][0-9]|3[0-2]))?$"
    low = (1 << (32 - subnet_bits)) - 1

    def inside(net):
        part = lambda p, k: F.get(p, k).try_cast("bigint")
        n = _once(F.split(net, r"\."), lambda p: part(p, 0) * 16777216 + part(p, 1) * 65536 + part(p, 2) * 256 + part(p, 3))
        return n.bitwiseAND(F.lit(0xFFFFFFFF ^ low)).bitwiseOR(number(seeded(net, seed)).bitwiseAND(F.lit(low)))

    dotted = lambda n: F.concat_ws(".", *[F.shiftright(n, 8 * k).bitwiseAND(F.lit(255)).cast("string") for k in (3, 2, 1, 0)])

    def network(new, length):
        # a network's own address: no bits beyond the prefix
        size = F.pow(F.lit(2), 32 - length).cast("bigint")
        return F.concat(_once(new - new % size, dotted), F.lit("/"), length.cast("string"))

    def masked(p):
        # an address alone has no length: a cast of what isn't a number would throw and be caught, row by row
        net, length = F.get(p, 0), F.get(p, 1).try_cast("int")
        keep = F.lit(False) if mask_localhost else net.startswith("127.")
        new = F.when(length.isNull(), _once(inside(net), dotted)).otherwise(_once(inside(net), lambda n: network(n, length)))
        return F.when(~keep, new)

    return _once(canonical(c), lambda v: F.coalesce(F.when(F.trim(v).rlike(form), _once(F.split(F.trim(v), "/"), masked)), v))


def mask_ipv6(c: Column, seed: object = 0, subnet_bits: int = 16) -> Column:
    """IPv6 in Arrow batches: addresses have too many written forms for an expression."""
    import hashlib
    import ipaddress

    def one(v):
        if v is None:
            return None
        try:
            a = ipaddress.IPv6Address(v.strip())
        except ValueError:
            return v
        if a.is_loopback:
            return v
        low = (1 << (128 - subnet_bits)) - 1
        h = int(hashlib.sha256(f"{seed}:{v.strip()}".encode()).hexdigest()[:32], 16)
        return str(ipaddress.IPv6Address((int(a) & ~low) | (h & low)))

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(canonical(c))


#: Named patterns, of ASCII only: Java, RE2 and Python read them alike.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone_us": r"\+?1?[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[.-][0-9]{4}",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "credit_card": r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b",
    "url": r"https?://[^ \t\n\r]+",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "date_us": r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b",
}


def mask_text(c: Column, patterns: list, replacement: str = "[REDACTED]", ignore_case: bool = True, keep_length: bool = False) -> Column:
    """Each pattern (a name of ``PATTERNS`` or an expression) in turn; one that doesn't compile is skipped.

    ``keep_length`` repeats the replacement's first character over the match; that runs in Arrow batches."""
    own = []
    for p in patterns:
        p = PATTERNS.get(p, p)
        try:
            re.compile(p)
        except re.error:
            continue
        own.append(p)
    if keep_length:
        compiled = [re.compile(p, re.I * ignore_case) for p in own]
        mark = replacement[:1]

        @F.pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            def one(v):
                for p in compiled:
                    v = p.sub(lambda m: mark * len(m[0]), v)
                return v

            return s.map(lambda v: None if v is None else one(v))

        return run(canonical(c))
    out = canonical(c)
    new = replacement.replace("\\", "\\\\").replace("$", "\\$")
    for p in own:
        out = F.regexp_replace(out, ("(?i)" if ignore_case else "") + p, new)
    return out


def mask_retention(c: Column, keep_start: int = 0, keep_end: int = 4, mark: str = "*", percent: int = 100, seed: object | None = None) -> Column:
    """Keeps ends of the trimmed value and masks the letters and digits between, other characters stay.
    ``percent`` below 100 masks the first such share of them, one at least.  With a seed: its hash at that length."""
    t = F.trim(canonical(c))
    n = F.length(t)
    if seed is not None:
        return F.substr(seeded(t, seed), F.lit(1), n)
    middle = F.substr(t, F.lit(keep_start + 1), F.greatest(n - keep_start - keep_end, F.lit(0)))
    if percent >= 100:
        middle = F.regexp_replace(middle, "[A-Za-z0-9]", mark)
    else:
        most = F.greatest(F.floor(F.length(middle) * percent / 100), F.lit(1))
        done = lambda acc: F.length(acc) - F.length(F.replace(acc, F.lit(mark), F.lit("")))
        middle = F.aggregate(F.split(middle, ""), F.lit(""), lambda acc, ch: F.concat(acc, F.when(ch.rlike("[A-Za-z0-9]") & (done(acc) < most), F.lit(mark)).otherwise(ch)))
    return F.when(n <= keep_start + keep_end, t).otherwise(F.concat(F.substr(t, F.lit(1), F.lit(keep_start)), middle, F.substr(t, n - keep_end + 1)))


def redact_url(c: Column) -> Column:
    """The password of ``scheme://user:password@host`` as ``***``; the user stays."""
    return F.regexp_replace(canonical(c), r"^([A-Za-z][A-Za-z0-9+.-]*://[^:/@?#]*):[^@/]*@", "$1:***@")


def url_password(c: Column) -> Column:
    """That password, null if there is none."""
    p = F.regexp_extract(canonical(c), r"^[A-Za-z][A-Za-z0-9+.-]*://[^:/@?#]*:([^@/]*)@", 1)
    return F.when(p != "", p)


# differential privacy


class PrivacyBudget:
    """The budget of one run, kept on the driver: a query is charged for its rows before it runs."""

    def __init__(self, total: float):
        self.total, self.spent = float(total), 0.0

    def charge(self, rows: int, epsilon: float) -> None:
        cost = rows * epsilon
        if self.spent + cost > self.total + 1e-12:
            raise ValueError(f"privacy budget exhausted: {self.spent} of {self.total} spent, {cost} more asked for")
        self.spent += cost

    def status(self) -> dict[str, float]:
        return {"total": self.total, "consumed": self.spent, "remaining": self.total - self.spent, "percent": 100 * self.spent / self.total if self.total else 0.0}


def dp_noise(c: Column, epsilon: float = 1.0, sensitivity: float = 1.0, mechanism: str = "laplace", delta: float = 1e-5, seed: int | None = None) -> Column:
    """The number with noise: Laplace of scale s/e, Gaussian of sigma sqrt(2 ln(1.25/d)) s/e, or a signed exponential."""
    if epsilon <= 0 or sensitivity <= 0:
        raise ValueError("epsilon and sensitivity must be positive")
    if mechanism == "gaussian":
        import math

        return c + F.randn(seed) * math.sqrt(2 * math.log(1.25 / delta)) * sensitivity / epsilon
    u = F.rand(seed) - 0.5
    size = -F.log(F.greatest(1 - 2 * F.abs(u), F.lit(1e-300))) * sensitivity / epsilon
    if mechanism in ("laplace", "exponential"):
        return c + F.signum(u) * size
    raise ValueError(f"unknown mechanism: {mechanism}")


EMAIL_FORM = r"^[^@]+@[^@]+\.[^@]+$"
PHONE_FORM = r"^[0-9\s\-+()]{10,}"


def valid_email(c: Column) -> Column:
    return F.trim(canonical(c)).rlike(EMAIL_FORM)


def valid_phone(c: Column) -> Column:
    return F.trim(canonical(c)).rlike(PHONE_FORM)
