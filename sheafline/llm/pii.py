"""Format-preserving pseudonyms for personal data, in built-in functions only.

Values are found by one pattern and validated by kind: payment cards (Luhn),
IPv4 addresses (octets), telephone numbers, social security numbers (area,
group, serial) and dates (calendar).  A validated value is a number in a domain
that depends on the value and not on how it is written, split as l < A and
r < B, and goes through a keyed alternating Feistel network on Z_A x Z_B, which
is a permutation of the domain; then it is written in the form it was found in.
So equal values get equal pseudonyms in all documents and all their forms,
different ones different pseudonyms, and the pseudonym is valid again:

* cards: the digits before the check digit, by length;
* IPv4: 32 bits (an octet written with leading zeros keeps its width);
* telephone numbers of ten digits, with or without +1: area and exchange stay
  on their side of 200; others: the digits behind the first one;
* dates: the day, 1900 to 2099.  Days up to the 12th and later ones are domains
  of their own, so that slash dates, which are read as day/month/year where they
  can be, never meet those that can only be month/day/year;
* social security numbers: area, group and serial.

Mail addresses and secrets have no numeric domain; they become keyed digests of
their shape.  What looks like a value but fails its check stays as it is, and so
does an unbroken run of ten digits, which is no telephone number by itself.

A card in a usual grouping is found whatever number stands before or after it:
where the text holds a valid one, a mark (a code point that is no character) is
put before it, and the pattern takes marked cards first; other groupings are
found only where no more digits follow.

All patterns are fixed and look at a bounded number of characters from each
place, so the cost is linear in the text whatever it holds.  There is no
shuffle.  The key is required and belongs in a secret store (see `key_of`).

Cases: null text stays null with no values; empty text stays empty; repeated
rows give equal rows; an empty table gives an empty table; of the other columns
only those in `keep` are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: Dates lie in the 73,049 days (2,400 months) from here.
FIRST_DAY, MONTHS = "1900-01-01", 2400
#: Days up to the 12th of a month: 28,800. Later days: 44,249, one less than the domain.
EARLY_A, EARLY_B, LATE_A, LATE_B, LATE = 160, 180, 150, 295, 44249
#: Valid areas 001-899 but 666, groups 01-99, serials 0001-9999.
SSN_A, SSN_B = 898 * 99, 9999
KINDS = ("email", "ipv4", "phone", "card", "ssn", "date", "secret")
#: Session setting that holds the key.
KEY_CONF = "spark.sheafline.pii.key"

#: Marks before a valid card in a usual grouping (long, other), and what a mark of the text itself is followed by meanwhile.
_MARK_LONG, _MARK, _OWN = "\ufdd0", "\ufdd1", "\ufdd2"
_ANY = f"[{_MARK_LONG}{_MARK}]"
_EMAIL = r"[A-Za-z0-9_][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}+\.){1,16}[A-Za-z]{2,24}+"
_IP = r"(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
_DATE = r"\d{4}-\d{2}-\d{2}(?![\d-])|\d{2}[/.]\d{2}[/.]\d{4}(?!\d)"
_SSN = r"\d{3}-\d{2}-\d{4}(?![\d-])"
_CARD = r"\d(?:[ -]?\d){12,18}(?![ -]?\d)"
_PHONE = r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-]?)\d{3}[ .-]?\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\d){7,12}(?!\d)"
_SECRET = r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?i:password|passwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,}+"
#: Usual groupings of a card; the longest that starts at a place counts first if it is valid.
_LONG_GROUPS = r"\d{4}(?:[ -]\d{4}){3}[ -]\d{3}"
_GROUPS = r"\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{4}[ -]\d{4}[ -]\d{5}|\d{6}[ -]\d{13}"
#: Starts of groupings, but for those inside a mail address.
_STARTS = rf"(?=\d{{4}})(?<![A-Za-z0-9_@])(?=({_LONG_GROUPS}(?!\d))?)(?=({_GROUPS})(?!\d))(?![\d-]{{13,23}}[A-Za-z0-9._%+-]{{0,63}}+@[A-Za-z0-9])"


def _marked(groups: str) -> str:
    """The grouping with marks of later starts in it."""
    return groups.replace("[ -]", f"[ -]{_ANY}?")


#: Guards of one character keep most places from trying the alternatives behind them.
PATTERN = (
    rf"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_(+{_MARK_LONG}{_MARK}])(?:{_EMAIL}|(?=[0-9(+])(?:{_IP}|{_DATE}|{_SSN}|{_CARD}|{_PHONE})|(?=[AaPpTtSs])(?:{_SECRET})"
    rf"|{_MARK_LONG}{_marked(_LONG_GROUPS)}(?!\d)|{_MARK}(?:{_marked(_GROUPS)})(?!\d))"
)


def key_of(spark: SparkSession, default: str | None = None) -> str:
    """The session's key (KEY_CONF); the default where it has none, an error without one."""
    key = spark.conf.get(KEY_CONF, default)
    if not key:
        raise ValueError(f"no key for pseudonyms: set {KEY_CONF}")
    return key


def _num(s: Column) -> Column:
    """A digit string as a long, null where it isn't one."""
    return s.try_cast("long")


def _pow10(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").try_cast("long")


def _luhn_sum(digits: Column, offset: int) -> Column:
    """Luhn sum; the last digit counts single with offset 0 and double with offset 1."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when((i + offset) % 2 == 0, c.try_cast("int")).otherwise(F.lit(0) + (c.try_cast("int") * 2).cast("int") - F.when(c.try_cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _leap(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def _month_days(y: Column, m: Column) -> Column:
    return F.when(m == 2, F.when(_leap(y), 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _valid_day(y: Column, m: Column, d: Column) -> Column:
    return y.between(1900, 2099) & m.between(1, 12) & (d >= 1) & (d <= _month_days(y, m))


def _digest(key: str, value: Column) -> Column:
    """128 hex digits of a keyed digest."""
    return F.sha2(F.concat(F.lit(key), F.lit("\x1f"), value), 512)


def _classify(m: Column) -> Column:
    """struct(m, kind, digits, form): kind null where the check fails; form: how the digits stand."""
    digits = F.regexp_replace(m, r"\D", "")
    n = F.length(digits)
    octets = F.split(m, r"\.")
    ip = m.rlike(r"^(\d{1,3}\.){3}\d{1,3}$") & F.forall(octets, lambda o: F.coalesce(o.try_cast("int"), F.lit(999)) <= 255)
    iso = m.rlike(r"^\d{4}-\d{2}-\d{2}$")
    local = m.rlike(r"^\d{2}[/.]\d{2}[/.]\d{4}$")
    part = lambda a, k: _num(F.substring(digits, a, k))
    ymd = iso & _valid_day(part(1, 4), part(5, 2), part(7, 2))
    dmy = local & _valid_day(part(5, 4), part(3, 2), part(1, 2))
    mdy = local & _valid_day(part(5, 4), part(1, 2), part(3, 2))
    ssn = m.rlike(r"^\d{3}-\d{2}-\d{4}$") & part(1, 3).between(1, 899) & (part(1, 3) != 666) & (part(4, 2) > 0) & (part(6, 4) > 0)
    card = m.rlike(r"^\d[\d -]*\d$") & n.between(13, 19) & (_luhn_sum(digits, 0) % 10 == 0)
    ten = (n == 10) | ((n == 11) & digits.startswith("1"))
    phone = m.rlike(r"^[+(\d][\d ().-]*\d$") & F.when(m.startswith("+"), n.between(8, 15)).otherwise(ten & m.rlike(r"[ ().-]"))
    form = (
        F.when(F.contains(m, F.lit("@")), "email").when(m.rlike(r"^AKIA[A-Z0-9]{16}$"), "key").when(m.rlike(r"^[A-Za-z]"), "secret")
        .when(ip, "ipv4").when(ymd, "ymd").when(dmy, "dmy").when(mdy, "mdy").when(ssn, "ssn").when(card, "card").when(phone & ten & ~(m.startswith("+") & (n == 10)), "nanp").when(phone, "phone")
    )
    kind = F.when(form.isin("key", "secret"), "secret").when(form.isin("ymd", "dmy", "mdy"), "date").when(form.isin("nanp", "phone"), "phone").otherwise(form)
    return F.struct(m.alias("m"), form.alias("form"), kind.alias("kind"), digits.alias("digits"))


def _split(x: Column) -> Column:
    """struct(..., domain, l, a, r, b): the value as a point of Z_a x Z_b (nulls where no number is permuted)."""
    form, d = x["form"], x["digits"]
    part = lambda a, k: _num(F.substring(d, a, k))
    octet = lambda i: F.try_element_at(F.split(x["m"], r"\."), F.lit(i)).try_cast("long")
    y = F.when(form == "ymd", part(1, 4)).otherwise(part(5, 4))
    mo = F.when(form == "ymd", part(5, 2)).when(form == "dmy", part(3, 2)).otherwise(part(1, 2))
    da = F.when(form == "ymd", part(7, 2)).when(form == "dmy", part(1, 2)).otherwise(part(3, 2))
    is_date = form.isin("ymd", "dmy", "mdy")
    months = (y - 1900) * 12 + mo - 1
    day = F.when(is_date, F.datediff(F.make_date(F.when(is_date, y.cast("int")), F.when(is_date, mo.cast("int")), F.when(is_date, da.cast("int"))), F.lit(FIRST_DAY).cast("date")).cast("long"))
    early = is_date & (da <= 12)
    nth = F.when(early, months * 12 + da - 1).when(is_date, day - 12 * (months + 1))  # the number of the day in its domain
    width = F.when(early, EARLY_A).otherwise(LATE_A)
    area = part(1, 3)
    area = area - 1 - F.when(area > 666, 1).otherwise(0)
    last10 = F.substring(d, -10, 10)
    first, second, tail = (_num(F.substring(last10, at, k)) for at, k in ((1, 3), (4, 3), (7, 4)))
    low, mid = first < 200, second < 200  # such an area has any exchange
    first_n, second_n = F.when(low, 200).otherwise(800), F.when(low, 1000).when(mid, 200).otherwise(800)
    first_0, second_0 = F.when(low, 0).otherwise(200), F.when(low | mid, 0).otherwise(200)
    # The check digit of a card is made anew; the first digit of a telephone number with a country code stays.
    skip = F.when(form == "phone", 1).otherwise(0)
    n = F.length(d) - F.when(form.isin("card", "phone"), 1).otherwise(0)
    k = F.floor(n / 2).cast("int")
    left, right = _num(F.substr(d, skip + 1, k)), _num(F.substr(d, skip + k + 1, n - k))
    l = (  # noqa: E741
        F.when(form == "ipv4", octet(1) * 256 + octet(2)).when(is_date, nth % width).when(form == "ssn", area * 99 + part(4, 2) - 1)
        .when(form == "nanp", (first - first_0) * 100 + F.floor(tail / 100)).when(form.isin("card", "phone"), left)
    )
    r = (
        F.when(form == "ipv4", octet(3) * 256 + octet(4)).when(is_date, F.floor(nth / width)).when(form == "ssn", part(6, 4) - 1)
        .when(form == "nanp", (second - second_0) * 100 + tail % 100).when(form.isin("card", "phone"), right)
    )
    a = F.when(form == "ipv4", F.lit(65536)).when(is_date, width).when(form == "ssn", SSN_A).when(form == "nanp", first_n * 100).otherwise(_pow10(k))
    b = F.when(form == "ipv4", F.lit(65536)).when(is_date, F.when(early, EARLY_B).otherwise(LATE_B)).when(form == "ssn", SSN_B).when(form == "nanp", second_n * 100).otherwise(_pow10(n - k))
    domain = F.when(early, "early").when(is_date, "late").when(form.isin("card", "phone"), F.concat_ws(":", form, n.cast("string"))).otherwise(form)
    return F.struct(
        x["m"].alias("m"), form.alias("form"), x["kind"].alias("kind"), d.alias("digits"), k.alias("k"), n.alias("n"), domain.alias("domain"),
        l.cast("long").alias("l"), a.cast("long").alias("a"), r.cast("long").alias("r"), b.cast("long").alias("b"),
        first_0.cast("long").alias("first_0"), second_0.cast("long").alias("second_0"),
    )


def _rounds(domain: Column, l: Column, a: Column, r: Column, b: Column, key: str, end: Callable[[Column], Column] | None = None) -> Column:  # noqa: E741
    """struct(l, r) after ROUNDS alternating additions of keyed digests, and what `end` makes of it."""

    def word(i: Column, v: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), domain, i.cast("string"), v.cast("string")), 256), 1, 15), 16, 10).cast("long")

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(acc["l"] + F.pmod(word(i, acc["r"]), a), a)).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + F.pmod(word(i, acc["l"]), b), b)).alias("r"),
        )

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), F.struct(l.alias("l"), r.alias("r")), step, end)


def _feistel(x: Column, key: str) -> Column:
    """struct(l, r) of the permuted value. The one point of the late days that is no day walks on once, so the rest stays a permutation."""
    far = lambda v: F.lit(v).cast("long")
    on = _rounds(F.lit("late"), far(LATE % LATE_A), far(LATE_A), far(LATE // LATE_A), far(LATE_B), key)
    walk = lambda acc: F.when((x["domain"] == "late") & (acc["l"] + acc["r"] * LATE_A == LATE), on).otherwise(acc)
    return _rounds(x["domain"], x["l"], x["a"], x["r"], x["b"], key, walk)


def _refill(m: Column, digits: Column) -> Column:
    """m with its digits replaced one by one."""
    step = lambda acc, c: F.struct(
        F.concat(acc["out"], F.when(c.rlike(r"^\d$"), F.substr(digits, acc["at"], F.lit(1))).otherwise(c)).alias("out"),
        (acc["at"] + F.when(c.rlike(r"^\d$"), 1).otherwise(0)).alias("at"),
    )
    return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda acc: acc["out"])


def _date_of(x: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """The date of a point of the early or late days."""
    origin = F.lit(FIRST_DAY).cast("date")
    early = x["domain"] == "early"
    nth = F.coalesce(F.when(x["domain"].isin("early", "late"), l + r * F.when(early, EARLY_A).otherwise(LATE_A)), F.lit(0)).cast("int")
    before = lambda m: F.datediff(F.add_months(origin, m), origin) - 12 * m  # noqa: E731 - late days before a month
    near = F.floor(nth * MONTHS / LATE).cast("int")
    month = F.when(early, F.floor(nth / 12).cast("int")).otherwise(
        F.array_max(F.filter(F.sequence(F.greatest(near - 3, F.lit(0)), F.least(near + 3, F.lit(MONTHS - 1))), lambda m: before(m) <= nth))
    )
    return F.date_add(F.add_months(origin, month), F.when(early, nth % 12).otherwise(12 + nth - before(month)))


def _render(x: Column, p: Column, key: str) -> Column:
    form, m, d = x["form"], x["m"], x["digits"]
    l, r = p["l"], p["r"]  # noqa: E741
    pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
    octets = F.transform(F.array(F.floor(l / 256), l % 256, F.floor(r / 256), r % 256), lambda v: v.cast("string"))
    ip = F.array_join(F.zip_with(F.split(m, r"\."), octets, lambda o, v: F.when(F.startswith(o, F.lit("0")), F.lpad(v, F.greatest(F.length(o), F.length(v)), F.lit("0"))).otherwise(v)), ".")
    date = _date_of(x, l, r)
    y, mo, da = pad(F.year(date), 4), pad(F.month(date), 2), pad(F.day(date), 2)
    new_date = F.when(form == "ymd", F.concat(y, mo, da)).when(form == "dmy", F.concat(da, mo, y)).otherwise(F.concat(mo, da, y))
    area = F.floor(l / 99) + 1
    ssn = F.concat(pad(area + F.when(area >= 666, 1).otherwise(0), 3), pad(l % 99 + 1, 2), pad(r + 1, 4))
    nanp = F.concat(F.substr(d, F.lit(1), F.length(d) - 10), pad(F.floor(l / 100) + x["first_0"], 3), pad(F.floor(r / 100) + x["second_0"], 3), pad(l % 100, 2), pad(r % 100, 2))
    plain = F.concat(F.lpad(l.cast("string"), x["k"], "0"), F.lpad(r.cast("string"), x["n"] - x["k"], "0"))
    card = F.concat(plain, F.pmod(-_luhn_sum(plain, 1), F.lit(10)).cast("string"))
    digest = _digest(key, m)
    shape = F.translate(F.substring(digest, 1, 16), "0123456789abcdef", "ABCDEFGHIJKLMNOP")
    head = F.regexp_extract(m, r"^[A-Za-z_-]+\s*[=:]\s*[\"']?", 0)
    secret = F.concat(head, F.substr(F.repeat(digest, 8), F.lit(1), F.least(F.length(m) - F.length(head), F.lit(1024))))
    return (
        F.when(form == "email", F.concat(F.lit("u"), F.substring(digest, 1, 16), F.lit("@mail.invalid")))
        .when(form == "key", F.concat(F.lit("AKIA"), shape)).when(form == "secret", secret).when(form == "ipv4", ip)
        .when(x["kind"] == "date", _refill(m, new_date)).when(form == "ssn", _refill(m, ssn)).when(form == "nanp", _refill(m, nanp))
        .when(form == "card", _refill(m, card)).when(form == "phone", _refill(m, F.concat(F.substr(d, F.lit(1), F.lit(1)), plain))).otherwise(m)
    )


def pseudonyms(found: Column, key: str) -> Column:
    """array<struct<m, kind, pseudonym>> of an array of matches of PATTERN."""
    parts = F.transform(F.transform(found, lambda m: _classify(F.regexp_replace(m, _ANY, ""))), _split)
    both = F.transform(parts, lambda x: F.struct(x.alias("x"), F.when(x["l"].isNotNull() & x["r"].isNotNull(), _feistel(x, key)).alias("p")))
    return F.transform(both, lambda z: F.struct(z["x"]["m"].alias("m"), z["x"]["kind"].alias("kind"), _render(z["x"], z["p"], key).alias("pseudonym")))


def _marks(text: Column) -> Column:
    """The text with a mark before each valid card in a usual grouping; marks that it held before are followed by _OWN.

    A pattern has no Luhn sum, so valid cards are marked first: of
    '1234 4111 1111 1111 1111 12/29' no grouping alone tells where the card is.
    """
    text = F.when(text.rlike(_ANY), F.regexp_replace(text, f"({_ANY})", f"$1{_OWN}")).otherwise(text)
    long, other = (F.regexp_extract_all(text, F.lit(_STARTS), F.lit(k)) for k in (1, 2))
    valid = lambda m: (m != "") & (_luhn_sum(F.regexp_replace(m, r"[ -]", ""), 0) % 10 == 0)
    mark = F.zip_with(long, other, lambda a, b: F.when(valid(a), F.lit(_MARK_LONG)).when(valid(b), F.lit(_MARK)).otherwise(F.lit("")))
    # One more piece than starts, as a blank goes before: each but the first begins at a start.
    pieces = F.split(F.concat(F.lit(" "), text), _STARTS, -1)
    whole = F.array_join(F.zip_with(F.concat(F.array(F.lit("")), mark), pieces, lambda a, b: F.concat(a, b)), "")
    return F.when(text.rlike(_STARTS), F.substr(whole, F.lit(2))).otherwise(text)


def _made(found: Column, key: str) -> Column:
    none = F.array().cast("array<struct<m:string,kind:string,pseudonym:string>>")
    return F.when(F.size(found) > 0, pseudonyms(found, key)).otherwise(none)


def _rebuilt(text: Column, marked: Column, made: Column) -> Column:
    gaps = F.split(marked, PATTERN, -1)
    whole = F.array_join(F.zip_with(gaps, made, lambda g, x: F.concat(g, F.coalesce(x["pseudonym"], F.lit("")))), "")
    whole = F.when(text.rlike(_ANY), F.regexp_replace(whole, f"({_ANY}){_OWN}", "$1")).otherwise(whole)
    return F.when(F.size(made) > 0, whole).otherwise(text)


def _with_values(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs, _marked_ and _made_; each is a projection of its own, so that nothing is evaluated twice."""
    if not key:
        raise ValueError("pseudonyms need a key")
    rows = docs.withColumn("_marked_", _marks(F.col(text)))
    rows = rows.withColumn("_found_", F.regexp_extract_all(F.col("_marked_"), F.lit(PATTERN), F.lit(0)))
    return rows.withColumn("_made_", _made(F.col("_found_"), key)).drop("_found_")


def replace_in(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with pseudonyms in its text column; all columns stay in place."""
    return _with_values(docs, key, text).withColumn(text, _rebuilt(F.col(text), F.col("_marked_"), F.col("_made_"))).select(*docs.columns)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), values: bool = False) -> DataFrame:
    """keep columns, the text with pseudonyms, n_values, and n_<kind> for each kind; with the values themselves on request."""
    rows = _with_values(docs.select(*[F.col(c) for c in keep], F.col(text).alias("_text_")), key, "_text_")
    count = lambda k: F.size(F.filter(F.col("_made_"), lambda x: x["kind"] == k)).cast("long")
    out = [_rebuilt(F.col("_text_"), F.col("_marked_"), F.col("_made_")).alias("text"), F.size(F.filter(F.col("_made_"), lambda x: x["kind"].isNotNull())).cast("long").alias("n_values")]
    return rows.select(*keep, *out, *[count(k).alias(f"n_{k}") for k in KINDS], *([F.col("_made_").alias("values")] if values else []))
