"""Operator 3: keyed surrogates for personal data."""

from __future__ import annotations

import hashlib
import ipaddress
import os
import re
import secrets

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import parts, scan

#: Where the secret is configured; without one, a session makes its own, and what it replaced can't be undone later.
KEY_CONF, KEY_ENV = "spark.millrace.surrogates.key", "MILLRACE_SURROGATES_KEY"
ROUNDS = 8
KNOWN = 100_000  # surrogates a task remembers

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_TITLE_M = r"Mr|Mister|Herrn?|Monsieur|Señor|Sr|Don|Signor"
_TITLE_F = r"Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|Doña|Signora"
def _capitals() -> str:
    """All capital letters, as ranges of a character class."""
    at = [i for i in range(0x250) if chr(i).isupper()] + [i for i in range(0x250, 0x30000) if chr(i).isupper() or chr(i).istitle()]
    out, first = [], None
    for i, x in enumerate(at):
        first = x if first is None else first
        if i + 1 == len(at) or at[i + 1] != x + 1:
            out.append(f"{chr(first)}-{chr(x)}")
            first = None
    return "[" + "".join(out) + "]"


_UP = _capitals()
_LETTER = r"(?:[^\W\d_]|[\u0300-\u036f])"
#: A capital and letters of any script, inner capitals and apostrophes (but no possessive 's), to the
#: word's end; or an initial.
_CAP = rf"(?:{_UP}\.|{_UP}(?:{_LETTER}|['’](?!s(?!\w))(?={_LETTER}))*(?![\w\u0300-\u036f]))"
_PARTICLES = "van von der den dem de del della dello degli di da dal das dos du des la le los las ten ter zu zum zur af av al el bin ibn y e".split()
_PART = rf"(?:(?:{'|'.join(_PARTICLES)}) |[dl]['’](?={_UP}))"
_WHO = rf"{_PART}{{0,3}}{_CAP}(?:[ \-]{_PART}{{0,3}}{_CAP}){{0,3}}"
#: Given names after which a capital word is a surname; those that are also places or common words aren't listed.
_GIVEN = (
    "James John Robert Michael William David Richard Joseph Thomas Christopher Daniel Matthew Anthony Andrew Joshua Kenneth Kevin Brian Timothy Ronald "
    "Jason Edward Jeffrey Ryan Jacob Nicholas Gary Eric Jonathan Stephen Steven Larry Justin Scott Brandon Benjamin Samuel Gregory Alexander Patrick Peter Paul "
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda "
    "Melissa Deborah Stephanie Rebecca Laura Helen Sharon Cynthia Kathleen Amy Angela Anna Emma Olivia Nicole Samantha Katherine Christine Rachel Janet Maria Alice Jane "
    "Hans Klaus Jürgen Wolfgang Günter Dieter Stefan Andreas Thorsten Matthias Ulrich Heinz Karl Friedrich Johannes Lukas Felix Ursula Monika Petra Sabine Ingrid Heike Katharina Birgit "
    "Jean Pierre Jacques François Philippe Michel Nicolas Julien Antoine Marie Nathalie Isabelle Sylvie Françoise Hélène Amélie Céline Camille "
    "José Juan Carlos Luis Miguel Pedro Javier Fernando Alejandro Manuel Jorge Carmen Ana Isabel Lucía Pilar Rosario Giovanni Giuseppe Marco Francesco Luca Paolo Giulia Chiara Francesca "
    "Jan Łukasz Piotr Krzysztof Andrzej Katarzyna Agnieszka Jiří Petr Pavel Tomáš Иван Сергей Александр Дмитрий Алексей Андрей Анна Мария Ольга Елена Татьяна Наталья").split()
_NAMED = rf"(?:{'|'.join(sorted(set(_GIVEN), key=len, reverse=True))})"
_H = "[0-9A-Fa-f]{1,4}"
_KEY = r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk_live_|sk_test_|sk-|xox[abprs]-|AIza|hf_|npm_"
_DATA = (
    rf"(?P<email>[\w.%+\-]+@[\w\-]+(?:\.[\w\-]+)+)"
    rf"|(?P<iban>(?<!\w)[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?!\w))"
    rf"|(?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{{32,}}|[0-9A-F]{{32,}})(?![0-9A-Za-z])"
    rf"|(?<![\w\-])(?:{_KEY})[A-Za-z0-9_\-]{{16,}}"
    rf"|(?<=[\"'])(?=[A-Za-z_\-]*[0-9])[A-Za-z0-9_\-]{{20,}}(?=[\"']))"
    rf"|(?P<card>(?<!\d)(?:[0-9]{{13,19}}|[0-9]{{4}}(?:[ \-][0-9]{{4}}){{3}}|[0-9]{{4}}[ \-][0-9]{{6}}[ \-][0-9]{{5}})(?!\d))"
    rf"|(?P<ssn>(?<![\d\-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![\d\-]))"
    rf"|(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:{_H}:){{7}}{_H}|(?:{_H}(?::{_H}){{0,6}})?::(?:{_H}(?::{_H}){{0,6}})?)(?![\w:]))"
    rf"|(?P<ip>(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d))"
    rf"|(?P<phone>\+[0-9]{{1,3}}[ .\-]?(?:\([0-9]{{1,4}}\)[ .\-]?)?[0-9](?:[ .\-]?[0-9]){{5,12}}(?!\d)"
    rf"|\([0-9]{{2,4}}\) ?[0-9]{{3,4}}[ .\-][0-9]{{3,4}}(?!\d)|(?<![\d.\-])[0-9]{{3}}[.\-][0-9]{{3}}[.\-][0-9]{{4}}(?!\d)"
    rf"|(?<![\w.\-+/])0[1-9](?:[ .\-][0-9]{{2}}){{4}}(?!\d)|(?<![\w.\-+/])\(?0[1-9][0-9]{{1,4}}\)?[ /\-][0-9]{{3,4}}[ \-][0-9]{{3,4}}(?!\d)"
    rf"|(?<![\w.\-+/])\(?0[1-9][0-9]{{1,4}}\)?[ /][0-9]{{6,8}}(?!\d))"
)
_NAME = (
    rf"(?P<name>(?<!\w)(?:(?P<m>{_TITLE_M})|(?P<f>{_TITLE_F})|Dr|Prof)\.? (?P<who>{_WHO})"
    rf"|(?<!\w)(?P<given>{_NAMED}(?: {_UP}\.)?[ \-]{_WHO}))"
)
#: Of the first of these that is met, emails first; texts with data or names only are searched for those only.
ENTITY, DATA, NAME = re.compile(f"{_DATA}|{_NAME}"), re.compile(_DATA), re.compile(_NAME)
#: Data have a digit or an @, the beginning of a key, or two colons; names a title or a given name among the words
#: that begin with a capital (or with another letter than a small Latin one).
_DIGIT, _CAPITALIZED = re.compile("[0-9@]"), re.compile("[^\\W\\d_a-zß-öø-ÿ]\\w+")
_BEGINS = (*"AKIA ASIA ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- sk_live_ sk_test_ sk- xoxa- xoxb- xoxp- xoxr- xoxs- AIza hf_ npm_".split(), "::")
_NAME_WORDS = frozenset(_GIVEN) | frozenset(f"{_TITLE_M}|{_TITLE_F}|Dr|Prof|Herr".replace("Herrn?", "Herrn").split("|"))
#: Calling codes of one and two digits; all others have three.
_CODE = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3}")

#: Characters that may stand for each other, by script and by kind; the place in the string is the digit.
_CLASSES = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûü", "çñðþßýÿ",
    "āăąēĕėęěīĭįōŏőœūŭůűų", "ćĉċčďđĝğġģĥħĵķĺļľłńņňŕŗřśŝşšţťŧŵŷźżž", "іїєў", "ґђѓјљњћќџ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρστφχψ",  # ς only ends a word: in capitals it would be another σ

)
_AT = {c: (alphabet, i) for alphabet in _CLASSES for i, c in enumerate(alphabet)}
_HEX = {c: ("0123456789abcdef", i) for i, c in enumerate("0123456789abcdef")}


class Surrogates:
    """Keyed replacements that are one-to-one by construction.

    The characters that may change, each a digit of its own radix, are one number n below M.  A
    Feistel permutation P of 0..M-1, keyed by secret, kind and shape, gives the surrogate
    P'(P(n) + 1): a permutation again, and one without fixed points.  So different originals of a
    shape have different surrogates, no original stands for itself, and an original has the same
    surrogate wherever it occurs.  The shape (length, script, kind of each character, separators) stays."""

    def __init__(self, key: str):
        self.key = hashlib.sha256(key.encode()).digest()
        self.known: dict = {}

    def _round(self, tweak: bytes, i: int, x: int, bits: int) -> int:
        size = -(-bits // 8)
        h = hashlib.blake2b(x.to_bytes(size + 1, "big") + tweak, key=self.key, digest_size=min(64, size + 8), person=b"mr%d" % i).digest()
        while len(h) < size:
            h += hashlib.blake2b(h, key=self.key).digest()
        return int.from_bytes(h, "big") & ((1 << bits) - 1)

    def _permute(self, n: int, m: int, tweak: bytes, back: bool = False) -> int:
        half = max(1, -(-(m - 1).bit_length() // 2))
        mask = (1 << half) - 1
        while True:
            a, b = n >> half, n & mask
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    a, b = b ^ self._round(tweak, i, a, half), a
                else:
                    a, b = b, a ^ self._round(tweak, i, b, half)
            n = a << half | b
            if n < m:  # walk the cycle back into the range
                return n

    def number(self, n: int, m: int, tweak: str) -> int:
        if m < 2:
            return n
        t = tweak.encode()
        return self._permute((self._permute(n, m, t) + 1) % m, m, t, back=True)

    def text(self, s: str, kind: str, classes: dict = _AT, fixed: frozenset = frozenset()) -> str:
        """Of a lower-case string; characters of no class, and those at ``fixed`` places, stay."""
        places = [(i, *classes[c]) for i, c in enumerate(s) if c in classes and i not in fixed]
        n, m = 0, 1
        for _, alphabet, d in places:
            n, m = n * len(alphabet) + d, m * len(alphabet)
        shape = list(s)
        for i, alphabet, _ in places:
            shape[i] = "\0" + alphabet[0]
        n = self.number(n, m, f"{kind}|{''.join(shape)}")
        out = list(s)
        for i, alphabet, _ in reversed(places):
            n, d = divmod(n, len(alphabet))
            out[i] = alphabet[d]
        return "".join(out)

    def digits(self, s: str, kind: str) -> str:
        return str(self.number(int(s), 10 ** len(s), f"{kind}|{len(s)}")).zfill(len(s)) if s else s

    def of(self, kind: str, s: str) -> str:
        """The surrogate of an entity as it is written."""
        k = (kind, s)
        got = self.known.get(k)
        if got is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            got = self.known[k] = getattr(self, f"_{kind}")(s)
        return got

    def _email(self, s):
        local, _, domain = s.lower().rpartition("@")
        name, _, top = domain.rpartition(".")
        return _cased(s, f"{self.text(local, 'local')}@{self.text(name, 'domain')}.{top}")

    def _secret(self, s):
        if prefix := re.match(_KEY, s):  # tells the kind of key
            return _cased(s, self.text(s.lower(), "secret", fixed=frozenset(range(prefix.end()))))
        hexa = all(c in _HEX for c in s.lower())
        return _cased(s, self.text(s.lower(), "hex" if hexa else "secret", _HEX if hexa else _AT))

    def _digits_of(self, s, new):
        it = iter(new)
        return "".join(next(it) if c.isdigit() else c for c in s)

    def _card(self, s):
        d = "".join(c for c in s if c.isdigit())
        if luhn(d):
            body = self.digits(d[:-1], "card")
            return self._digits_of(s, body + next(c for c in "0123456789" if luhn(body + c)))
        new = self.digits(d, "cardlike")
        while luhn(new):  # one-to-one among numbers without a valid check digit
            new = self.digits(new, "cardlike")
        return self._digits_of(s, new)

    def _ssn(self, s):
        return self._digits_of(s, self.digits(s.replace("-", ""), "ssn"))

    def _phone(self, s):
        """One number has one surrogate, whatever its separators: the calling code or trunk 0 stays."""
        d = "".join(c for c in s if c.isdigit())
        if s[0] == "+":
            n = len(_CODE.match(d)[0])
            code = d[:n]
            n += "(0)" in s and d[n] == "0"  # the trunk 0 that isn't dialled
        else:
            n = int(d[0] == "0")
            code = "0" if n else "1"  # ten digits of a +1 number
        return self._digits_of(s, d[:n] + self.digits(d[n:], "phone" + code))

    def _ip6(self, s):
        try:
            n = int(ipaddress.IPv6Address(s))
        except ValueError:
            return s
        return str(ipaddress.IPv6Address(self.number(n, 1 << 128, "ip6")))

    def _ip(self, s):
        n = 0
        for part in s.split("."):
            n = n << 8 | int(part)
        n = self.number(n, 1 << 32, "ip")
        return ".".join(str(n >> k & 255) for k in (24, 16, 8, 0))

    def _iban(self, s):
        flat = s.replace(" ", "")
        if _mod97(flat) != 1:
            return self.text(s.lower(), "ibanlike", fixed=frozenset({0, 1})).upper()
        body = self.text(flat[4:].lower(), "iban" + flat[:2]).upper()
        new = iter(f"{flat[:2]}{98 - _mod97(flat[:2] + '00' + body):02d}{body}")
        return "".join(c if c == " " else next(new) for c in s)

    def _name(self, s):
        """Word by word and wherever the word stands, so that a given name or a surname alone still refers
        to the same person.  The last letter stays, which in most languages marks gender."""
        return "".join(w if i % 2 or w in _PARTICLES else self._word(w) for i, w in enumerate(re.split(r"([ \-])", s)))

    def _word(self, w):
        low = w.lower()
        last = len(low) - 1
        keep = frozenset({last}) if any(c in _AT for c in low[:last]) and last > 1 else frozenset()
        return _cased(w, self.text(low, "name", fixed=keep))


def _cased(like: str, s: str) -> str:
    """``s`` with capitals where ``like`` has them (ß and ς have none)."""
    if len(like) != len(s):
        return s
    return "".join(b.upper() if a.isupper() and len(b.upper()) == 1 else b for a, b in zip(like, s))


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _mod97(iban: str) -> int:
    flat = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in flat)) % 97


def _is_ip6(s: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(s))
    except ValueError:
        return False


def entities(text: str | None):
    """(kind, start, end) of what is found, in order; kinds are tried in the order of ``ENTITY``.  Words of
    a name are found wherever else in the text they stand."""
    if text is None:
        return []
    data = _DIGIT.search(text) or any(k in text for k in _BEGINS)
    names = not _NAME_WORDS.isdisjoint(_CAPITALIZED.findall(text))
    if not data and not names:
        return []
    found, words = [], set()
    for m in (ENTITY if data and names else DATA if data else NAME).finditer(text):
        kind = m.lastgroup  # the outermost
        if kind == "ip6" and not _is_ip6(m[0]):
            continue
        a, z = m.span("who" if m["who"] else "given") if kind == "name" else m.span()
        found.append((kind, a, z))
        if kind == "name":
            words.update(w for w in re.split(r"[ \-]", text[a:z]) if len(w) > 2 and w not in _PARTICLES)
    if not words:
        return found
    again = re.compile(r"(?<![\w])(?:" + "|".join(sorted(map(re.escape, words), key=len, reverse=True)) + r")(?![\w\u0300-\u036f])")
    out, at = [], 0
    for e in [*found, (None, len(text), len(text))]:
        out += [("name", *m.span()) for m in again.finditer(text, at, e[1])]
        out.append(e)
        at = e[2]
    return out[:-1]


def replaced(text: str | None, s: Surrogates) -> tuple[str | None, int]:
    out, at, n = [], 0, 0
    for kind, a, z in entities(text):
        out += [text[at:a], s.of(kind, text[a:z])]
        at, n = z, n + 1
    return ("".join([*out, text[at:]]), n) if n else (text, 0)


def surrogate_key(spark: SparkSession) -> str:
    """The secret from the session's configuration or the environment; otherwise the session gets one of its own."""
    key = spark.conf.get(KEY_CONF, None) or os.environ.get(KEY_ENV)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_CONF, key)
    return key


def pseudonymize(docs: DataFrame, key: str | None = None, count: str | None = None) -> DataFrame:
    """``docs`` with every detected entity in ``text`` replaced, and if ``count`` names a column, how many; a
    column of that name is replaced.

    Nulls stay null, empty texts empty, texts without entities as they are; other columns pass
    through whatever their names, repeated rows repeat, an empty table stays empty.  Texts of any length are
    searched whole, and memory follows the longest.  Rows are independent: the key alone decides, nothing is
    shuffled, and a rerun of a lost task gives the same."""
    key = key or surrogate_key(docs.sparkSession)
    docs = docs.drop(count) if count else docs
    cols = docs.columns
    at_text = cols.index("text")

    def run(batches):
        s = Surrogates(key)
        for b in batches:
            texts = b.column(at_text).to_pylist()
            for at, part in parts(texts):
                got = [replaced(t, s) for t in part]
                own = [c.slice(at, len(part)) for c in b.columns]
                own[at_text] = pa.array([t for t, _ in got], pa.string())
                names = list(cols)
                if count:
                    own.append(pa.array([n for _, n in got], pa.int64()))
                    names.append(count)
                yield pa.RecordBatch.from_arrays(own, names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, schema + (f", `{count}` long" if count else ""))


def _plain(kind: str, s: str) -> str:
    """What an entity refers to, however it is written."""
    if kind == "phone":
        d = "".join(c for c in s if c.isdigit())
        if s[0] == "+":
            n = len(_CODE.match(d)[0])
            return "+" + d[:n] + d[n + ("(0)" in s and d[n] == "0") :]
        return d if d[0] == "0" else "+1" + d
    if kind in ("card", "ssn"):
        return "".join(c for c in s if c.isdigit())
    return str(ipaddress.IPv6Address(s)) if kind == "ip6" else s.lower().replace(" ", "")


def ledger(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(kind, original, surrogate, o, s), each once: what was found and what stands for it, names by the
    word; o and s are both without case and separators.  This table undoes the replacement, so it is as
    secret as the key."""
    key = key or surrogate_key(docs.sparkSession)

    def run(batches):
        s = Surrogates(key)
        for b in batches:
            for _, part in parts(b.column(0).to_pylist()):
                got = {(k, o) for t in part for k, a, z in entities(t) for o in (re.split(r"[ \-]", t[a:z]) if k == "name" else [t[a:z]]) if o not in _PARTICLES}
                rows = [(k, o, n, _plain(k, o), _plain(k, n)) for k, o in sorted(got) for n in [s.of(k, o)]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*rows) if rows else [()] * 5)], ["kind", "original", "surrogate", "o", "s"])

    return docs.select("text").mapInArrow(run, "kind string, original string, surrogate string, o string, s string").distinct()


def collisions(book: DataFrame) -> DataFrame:
    """The check of a ledger: surrogates that stand for more than one original, originals that have more
    than one surrogate, and originals that kept their form though they have a letter or digit to change.
    None is expected; all are sums by group."""
    can = "".join(_CLASSES)
    same = (F.col("o") == F.col("s")) & F.regexp_replace("o", r"(@.*)\.[^.@]*$", "$1").rlike(f"[{can}]")
    row = lambda why, at, other: F.struct(F.lit(why).alias("why"), "kind", F.col(at).alias("s"), F.col(other).alias("other"))
    # in one aggregation, as the ledger is found anew each time it is read
    rows = book.select(F.explode(F.array(row("shared", "s", "o"), row("split", "o", "s"), F.when(same, row("unchanged", "s", "o")))).alias("r")).filter("r IS NOT NULL").select("r.*")
    n = rows.distinct().groupBy("kind", "s", "why").agg(F.count("*").alias("n"))
    return n.filter("n > 1 OR why = 'unchanged'").select("kind", "s", "why")


def checked(docs: DataFrame, key: str | None = None, count: str | None = None) -> DataFrame:
    """``pseudonymize`` after its ledger was checked."""
    key = key or surrogate_key(docs.sparkSession)
    wrong = collisions(ledger(docs, key)).groupBy("kind", "why").count().collect()
    if wrong:
        raise ValueError(f"surrogates are not one-to-one: {[tuple(r) for r in wrong]}")
    return pseudonymize(docs, key, count)


def op3_surrogates(spark, sf_dir: str) -> DataFrame:
    return checked(scan(spark, sf_dir).select("doc_id", "text"), count="n_entities")
