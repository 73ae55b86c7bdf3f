"""Personal data behind format-preserving pseudonyms. DataFrame functions only.

Found are: e-mail addresses, payment card numbers (Luhn-valid, 13 to 19 digits), IBANs (mod-97-valid),
telephone numbers, US social security numbers, IPv4 addresses, dates (real ones, as YYYY-MM-DD,
YYYY/MM/DD, DD.MM.YYYY or MM/DD/YYYY), access keys and assigned secrets.

Numbers and dates go through a keyed Feistel network over their own domain, so the pseudonym has
the same form and is valid again, different values have different pseudonyms, and a value has the
same one wherever it stands, whatever its separators:

* card: its digits but the last as a number, then a new Luhn digit; phone: its digits but a leading
  +country code;
* SSN: its place among the 898 x 99 x 9999 numbers that can be issued;
* IPv4: its 32 bits, as 16 + 16;
* date: its day within the Gregorian cycle of 146097 = 189 x 773 days, counted from 1970; DD/MM/YYYY is read only
  where MM/DD/YYYY is no day, and moves among such dates only;
* account part of an IBAN (then new check digits), local part of an address, value of a secret: a
  Feistel network over the halves of the string, whose rounds shift each letter or digit within its
  own class.

Numbers often stand side by side. In a run of digits, single spaces and dashes that is not a card number as a whole, every
part that is printed as cards are and valid is one, from left to right (16 digits before 19); dates, SSNs and telephone
numbers between them follow their own rules. An IBAN that took in the next number or word is cut at its gaps until a part
is valid. Local parts of addresses are of 64 characters at most, domains (which stay as they are) of 31 labels, values of
secrets of 8 at least, so that no text takes more than linear time or a deep stack. A run of over 400 characters ends with
its last digit, gap or dash: a dotted number or an address that begins there is not seen.

Round values come from sha2(key, domain, round, other half). Null texts stay null. Text outside of what
is found is unchanged, as are numbers that fail their check (and dates of years outside 370 to 9969).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Names that hold in passing; a user's column of such a name would be lost, so none is likely.
FOUND_COL, NEW_COL = "__tessera_pii_found", "__tessera_pii_new"
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,30}[A-Za-z]{2,63}"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?"
DATE = r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}"
SSN = r"\d{3}-\d{2}-\d{4}"
IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
#: A run in which card numbers may be; the second form is for long ones.
CARD = r"\d(?:[ -]?\d){12,400}"
LONG_RUN = r"\d[\d -]{400,}+"
#: How card numbers are printed where other numbers stand beside them: a mark, groups and their form.
PRINTED = (("A", 1, r"\d{13,19}"), ("D", 4, r"\d{4}(?:[ -]\d{4}){3}"), ("E", 5, r"\d{4}(?:[ -]\d{4}){3}[ -]\d{1,3}"), ("C", 3, r"\d{4}[ -]\d{6}[ -]\d{4,5}"))
PHONE = r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}"
SECRET = r"(?:AKIA|ASIA)[A-Z0-9]{16}|(?i:password|passwd|pwd|secret|token|api_key|apikey)\s*[=:]\s*[\"']?[A-Za-z0-9_+/.~-]{7,}[A-Za-z0-9_+/=~-][\"']?"
FOUND = rf"{EMAIL}|(?<![A-Za-z0-9_]){LONG_RUN}|(?<![A-Za-z0-9_])(?:{SECRET}|{IBAN}|{DATE}|{SSN}|{IPV4}|{CARD}|{PHONE})(?![A-Za-z0-9_]|[.-]\d)"
#: Parts of a run whose groups bear the marks of cards that begin there.
MARKED = "|".join(rf"{mark}\d+(?:[ -][A-E]?\d+){{{n - 1}}}" for mark, n, _ in PRINTED)
BESIDE = r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{3}-\d{2}-[A-E]?\d{4}|\d{3}-\d{3}-[A-E]?\d{4})(?!\d|-[A-E]?\d)"
DAYS = 146_097
QUICK = r"[0-9@]|(?i:password|passwd|pwd|secret|token|api_?key)"


def call(name: str, *args: Column) -> Column:
    return F.call_function(name, *args)


def digest(*parts: Column) -> Column:
    """60 bits of sha2 as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("long")


def feistel(value: Column, a: Column, b: Column, key: Column, domain: str) -> Column:
    """Permutes a long in [0, a * b): its halves value div b and value mod b take turns to be moved by a digest of the other."""

    def step(s: Column, i: Column) -> Column:
        moved = lambda own, other, size: F.pmod(own + F.pmod(digest(key, F.lit(domain), i.cast("string"), other.cast("string")), size), size)
        return F.when(i % 2 == 0, F.struct(moved(s["l"], s["r"], a).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), moved(s["r"], s["l"], b).alias("r")))

    start = F.struct(call("div", value, b).alias("l"), F.pmod(value, b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def permuted_digits(digits: Column, key: Column, domain: str) -> Column:
    """As many digits, of at most 18."""
    n = F.length(digits)
    half = call("div", n, F.lit(2)).cast("int")
    return F.lpad(feistel(digits.cast("long"), ten_to(n - half), ten_to(half), key, domain).cast("string"), n, "0")


def into(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced one by one."""
    return F.array_join(F.zip_with(F.split(form, r"\d", -1), F.split(digits, ""), lambda gap, d: F.concat(gap, F.coalesce(d, F.lit("")))), "")


def stirred(text: Column, key: Column, domain: str) -> Column:
    """A permutation of the strings of one length and pattern of ASCII lower-case, upper-case and digit places."""

    def shifted(own: Column, other: Column, i: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", key, F.lit(domain), i.cast("string"), other), 256)

        def char(c: Column, j: Column, drawn: Column) -> Column:
            by = F.conv(F.substring(drawn, 4 * (j % 16) + 1, F.lit(4)), 16, 10).cast("int")
            inside = lambda low, size: F.char(F.lit(low) + F.pmod(F.ascii(c) - low + by, F.lit(size)))
            return F.when(c.rlike("^[a-z]$"), inside(97, 26)).when(c.rlike("^[A-Z]$"), inside(65, 26)).when(c.rlike("^[0-9]$"), inside(48, 10)).otherwise(c)

        # The stream is drawn once for a half, not for each of its characters.
        moved = F.transform(F.array(stream), lambda drawn: F.array_join(F.transform(F.split(own, ""), lambda c, j: char(c, j, drawn)), ""))[0]
        return F.when(own == "", own).otherwise(moved)

    def step(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(shifted(s["l"], s["r"], i).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), shifted(s["r"], s["l"], i).alias("r")))

    half = call("div", F.length(text) + 1, F.lit(2)).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(3)), start, step, lambda s: F.concat(s["l"], s["r"]))


def luhn_digit(payload: Column) -> Column:
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))
    total = F.aggregate(F.transform(F.split(F.reverse(payload), ""), value), F.lit(0), lambda a, x: a + x)
    return F.pmod(-total, F.lit(10)).cast("string")


def mod97(text: Column) -> Column:
    """The number that letters and digits spell, A = 10 to Z = 35, modulo 97."""
    step = lambda a, c: F.pmod(F.when(c.rlike("^[0-9]$"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55), F.lit(97))
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def first_valid(m: Column, gap: str, tails: int, valid) -> Column:
    """struct(own, tail): the longest valid start of ``m``, cut at ``gap`` with up to ``tails`` groups after it, or null."""
    parts = []
    for z in range(tails + 1):
        pattern = rf"^(.*?)((?:{gap}[^ -]+){{{z}}})$"
        parts.append(F.struct(*(F.regexp_extract(m, pattern, i).alias(n) for i, n in ((1, "own"), (2, "tail")))))
    return F.get(F.filter(F.array(*parts), lambda x: (F.length(x["own"]) > 0) & valid(x["own"])), F.lit(0))


def masked_card(m: Column, key: Column) -> Column:
    d = digits_of(m)
    payload = permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
    return F.when(is_card(m), into(m, F.concat(payload, luhn_digit(payload)))).otherwise(m)


def is_card(m: Column) -> Column:
    return F.length(digits_of(m)).between(13, 19) & m.rlike(f"^(?:{CARD})$") & call("luhn_check", digits_of(m))


def numbers(run: Column) -> Column:
    """A run cut into the numbers in it and what stands between them, as an array.

    Each group at which a valid card begins gets a mark, and a scan of the marked run takes the leftmost ones that do not
    overlap, and the other numbers between them.
    """

    def mark(groups: Column, g: Column, i: Column) -> Column:
        out = F.when(~g.rlike(r"^(?:\d{4}|\d{13,19})[ -]?$"), "")
        for name, n, form in PRINTED:
            part = g if n == 1 else F.array_join(F.slice(groups, i + 1, F.lit(n)), "")
            out = out.when(part.rlike(f"^{form}[ -]?$") & call("luhn_check", digits_of(part)), name)
        return out.otherwise("")

    pattern = f"{MARKED}|{BESIDE}"
    scanned = lambda t: F.flatten(F.zip_with(F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1)), lambda gap, x: F.array(gap, F.coalesce(x, F.lit("")))))
    marked = F.transform(F.array(F.split(run, "(?<=[ -])", -1)), lambda gs: F.array_join(F.transform(gs, lambda g, i: F.concat(mark(gs, g, i), g)), ""))
    return F.transform(F.transform(marked, scanned)[0], lambda x: F.regexp_replace(x, "[A-E]", ""))


def valid_iban(m: Column) -> Column:
    plain = F.replace(m, F.lit(" "))
    return F.length(plain).between(15, 34) & (mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1)


def iban(m: Column, key: Column) -> Column:
    plain = F.replace(m, F.lit(" "))
    country, new = F.substring(m, 1, 2), stirred(F.substring(plain, F.lit(5), F.length(plain)), key, "iban")
    whole = F.concat(country, F.lpad((98 - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0"), new)
    return F.when(valid_iban(m), F.array_join(F.zip_with(F.split(m, "[A-Z0-9]", -1), F.split(whole, ""), lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")).otherwise(m)


def pieces(m: Column) -> Column:
    """What was found, cut into values and what stands between them: the longest valid IBAN that it starts with and its
    rest, a run and its numbers; else one piece."""
    run = lambda t: t.rlike(f"^ ?(?:{CARD}|{LONG_RUN})$")
    start = F.when(m.rlike(f"^(?:{IBAN})$"), first_valid(m, " ", 5, valid_iban))
    both = F.coalesce(start, F.struct(F.lit("").alias("own"), m.alias("tail")))
    return F.transform(F.array(both), lambda x: F.concat(F.array(x["own"]), F.when(run(x["tail"]) & ~is_card(x["tail"]), numbers(x["tail"])).otherwise(F.array(x["tail"]))))[0]


def ssn(m: Column, key: Column) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = ((area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1) * 9999 + serial - 1
    new = feistel(F.when(valid, place).otherwise(0), F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), key, "ssn")
    whole = F.transform(F.array(new), lambda v: F.concat(
        F.lpad((call("div", v, F.lit(99 * 9999)) + 1 + F.when(call("div", v, F.lit(99 * 9999)) >= 665, 1).otherwise(0)).cast("string"), 3, "0"), F.lit("-"),
        F.lpad((F.pmod(call("div", v, F.lit(9999)), F.lit(99)) + 1).cast("string"), 2, "0"), F.lit("-"),
        F.lpad((F.pmod(v, F.lit(9999)) + 1).cast("string"), 4, "0")))[0]
    return F.when(valid, whole).otherwise(m)


def ipv4(m: Column, key: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    valid = F.forall(parts, lambda x: x < 256)
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    new = feistel(F.when(valid, value).otherwise(0), F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, "ipv4")
    whole = F.transform(F.array(new), lambda v: F.concat_ws(".", *(F.pmod(call("div", v, F.lit(256**i)), F.lit(256)).cast("string") for i in (3, 2, 1, 0))))[0]
    return F.when(valid, whole).otherwise(m)


def date(m: Column, key: Column) -> Column:
    """Days move among the days of a 400-year cycle. A slash date is MM/DD/YYYY if that is a day; the others (DD from
    13 on) move among themselves, so that the two forms never share a pseudonym."""
    start = F.lit("1970-01-01").cast("date")
    out = m
    for form, pattern in (("dd/MM/yyyy", r"^\d{2}/\d{2}/\d{4}$"), ("MM/dd/yyyy", r"^\d{2}/\d{2}/\d{4}$"), ("dd.MM.yyyy", r"^\d{2}\."), ("yyyy/MM/dd", r"^\d{4}/"), ("yyyy-MM-dd", r"^\d{4}-")):
        day = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), start).cast("long")
        low = F.pmod(day, F.lit(DAYS).cast("long"))
        if form == "dd/MM/yyyy":
            new = late_day(low, key)
        else:
            new = feistel(low, F.lit(189).cast("long"), F.lit(773).cast("long"), key, "date")
        moved = F.date_format(F.date_add(start, (day - low + new).cast("int")), form)
        # 0370-01-01 and 9969-12-31: whole cycles of four-digit years.
        out = F.when(m.rlike(pattern) & day.between(-584388, 2921939), moved).otherwise(out)
    return out


def late_day(low: Column, key: Column) -> Column:
    """Permutes the days of the cycle that are 13th or later in their month: 88497 = 9 x 9833 of them."""
    start = F.lit("1970-01-01").cast("date")
    months = lambda d: (F.year(d) - 1970) * 12 + F.month(d) - 1
    # Days before month i that are 13th or later; a month has 18.436875 of them on average.
    before = lambda i: F.datediff(F.add_months(start, i), start).cast("long") - 12 * i.cast("long")
    own = low - 12 * (months(F.date_add(start, low.cast("int"))).cast("long") + 1)
    new = feistel(own, F.lit(9).cast("long"), F.lit(9833).cast("long"), key, "late")
    guess = F.floor(new / F.lit(18.436875)).cast("int")
    at = lambda v, g: F.filter(F.array(g + 1, g, g - 1), lambda i: (i >= 0) & (before(i) <= v))[0]
    day = F.transform(F.array(F.struct(new.alias("v"), guess.alias("g"))), lambda x: F.transform(F.array(at(x["v"], x["g"])), lambda i: x["v"] + 12 * (i.cast("long") + 1))[0])[0]
    return day


def phone(m: Column, key: Column) -> Column:
    code = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    d = digits_of(rest)
    return F.when(F.length(d).between(7, 18), F.concat(code, into(rest, permuted_digits(d, key, "phone")))).otherwise(m)


def email(m: Column, key: Column) -> Column:
    local = F.regexp_extract(m, "^[^@]*", 0)
    return F.concat(stirred(local, key, "email"), F.substring(m, F.length(local) + 1, F.length(m)))


def secret(m: Column, key: Column) -> Column:
    name = F.regexp_extract(m, r"^(?:AKIA|ASIA|[A-Za-z_]+\s*[=:]\s*[\"']?)", 0)
    return F.concat(name, stirred(F.substring(m, F.length(name) + 1, F.length(m)), key, "secret"))


def pseudonym(m: Column, key: Column) -> Column:
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return F.when(whole(EMAIL), email(m, key)).when(whole(SECRET), secret(m, key)).when(whole(IBAN), iban(m, key)).when(whole(DATE), date(m, key)).when(whole(SSN), ssn(m, key)).when(whole(IPV4), ipv4(m, key)).when(whole(CARD), masked_card(m, key)).when(whole(PHONE), phone(m, key)).otherwise(m)


def protect(frame: DataFrame, key: str, text_col: str = "text", count_col: str = "n_found") -> DataFrame:
    """The rows with pseudonyms in the text, and the number of values that changed in ``count_col``."""
    text = F.col(text_col)
    some = F.coalesce(text.rlike(QUICK), F.lit(False))
    out = frame.drop(count_col).withColumn(FOUND_COL, F.when(some, F.transform(F.regexp_extract_all(text, F.lit(f"({FOUND})"), F.lit(1)), pieces)))
    out = out.withColumn(NEW_COL, F.when(F.size(FOUND_COL) > 0, F.transform(FOUND_COL, lambda parts: F.transform(parts, lambda m: pseudonym(m, F.lit(key))))))
    joined = F.array_join(F.flatten(F.zip_with(F.split(text, FOUND, -1), F.col(NEW_COL), lambda gap, parts: F.concat(F.array(gap), F.coalesce(parts, F.array().cast("array<string>"))))), "")
    changed = F.size(F.filter(F.zip_with(F.flatten(FOUND_COL), F.flatten(NEW_COL), lambda a, b: a != b), lambda x: x))
    return out.withColumns({text_col: F.when(F.size(FOUND_COL) > 0, joined).otherwise(text), count_col: F.greatest(changed, F.lit(0)).cast("long")}).drop(FOUND_COL, NEW_COL)
