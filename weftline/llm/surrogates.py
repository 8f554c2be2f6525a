"""Personal data replaced by keyed surrogates; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Guarded, checkpointed, stored

# Given names by gender and script, and titles.
GIVEN = {
    ("f", "Latin"): "Anna Maria Laura Sarah Emily Julia Sophie Claire Camille Carmen Lucia Elena Hannah Katharina Isabel Alice",
    ("m", "Latin"): "John James Robert Michael David Thomas Peter Paul Pierre Jacques Carlos Pablo Hans Stefan Lukas George",
    ("f", "Cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Светлана Татьяна",
    ("m", "Cyrillic"): "Иван Алексей Дмитрий Сергей Андрей Николай Михаил Павел",
    ("f", "Greek"): "Ελένη Κατερίνα Σοφία Γεωργία",
    ("m", "Greek"): "Γιώργος Νίκος Δημήτρης Κώστας",
}
TITLES = "Mr MR Mrs MRS Ms Dr Prof Herr Frau Monsieur Madame Mme Señor Señora"

# Syllables of surnames; the letters of each script as the first code point and how many follow.
SYLLABLES = {
    "Latin": "bar den fel gor hal kin lor men nor pel ras sol tan ver wil zan",
    "Cyrillic": "бар ден фел гор хал кин лор мен нор пел рас сол тан вер вил зан",
    "Greek": "βαρ δεν φελ γορ χαλ κιν λορ μεν νορ πελ ρασ σολ ταν βερ μιλ ζαν",
}
SCRIPTS = {
    "Latin": (0x61, 26),
    "Greek": (0x3B1, 17),
    "Cyrillic": (0x430, 32),
    "Armenian": (0x561, 38),
    "Hebrew": (0x5D0, 27),
    "Arabic": (0x628, 19),
    "Devanagari": (0x915, 37),
    "Bengali": (0x995, 20),
    "Tamil": (0xBAE, 12),
    "Thai": (0xE01, 46),
    "Georgian": (0x10D0, 33),
    "Hiragana": (0x304B, 40),
    "Katakana": (0x30AB, 40),
    "Han": (0x4E00, 20_000),
    "Hangul": (0xAC00, 11_000),
}

_ALL_GIVEN = " ".join(GIVEN.values()).split()
_PART = r"\p{Lu}(?:['’]\p{Lu})?[\p{Ll}\p{M}]++(?:\p{Lu}\p{Ll}++)?"
#: A name as written in a sentence, or in capitals; parts may be joined by hyphens.
_NAME = rf"(?:{_PART}(?:-{_PART}){{0,3}}|(?!(?:AND|THE|FOR|WITH|WAS|SAID)(?!\p{{L}}))\p{{Lu}}{{3,}}(?:-\p{{Lu}}{{2,}}){{0,3}})(?!\p{{L}})"
_GIVEN = "|".join(sorted(_ALL_GIVEN + [n.upper() for n in _ALL_GIVEN]))
_TITLE = "|".join(TITLES.split())

#: The kinds of entities and their patterns; where two fit at one place, the first counts.  Each starts with a
#: look at one character, so that most places of a text are passed at once.  Groups that repeat without a small bound are
#: possessive: those run as loops, others would need stack for each round.
PATTERNS = {
    "email": r"(?=[\p{L}\p{N}._%+-])(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "ip": r"(?=\d)(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}])(?!\.\d)",
    "phone": (
        # With a country code: seven digits or more.
        r"(?=\+\d)(?<![\p{L}\p{N}+])(?=\+(?:[ .()/-]{0,2}\d){7})\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,4}){2,5}(?!\d)(?!\.\d)"
        # Ten digits by three, three and four; nine or more after a zero, in groups; nine by threes.
        r"|(?=[\d(])(?<![\p{L}\p{N}+.(-])(?:\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)"
        r"|(?=0(?:[ /-]?\d){8,11}(?![\d]))0\d{1,4}[ /-]\d{2,8}(?:[ -]\d{2,4}){0,4}(?![\p{L}\d]|[.,-]\d)"
        r"|[6-9]\d\d \d{3} (?!000)\d{3}(?![\p{L}\d]|[ .,-]\d))"
    ),
    "ssn": r"(?=\d)(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "secret": (
        r"(?=[0-9a-fA-F])(?<![\p{L}\p{N}])(?=\d*+[a-fA-F])[0-9a-fA-F]{24,}+(?![\p{L}\p{N}])"
        r"|(?=[Ags])(?<![\p{L}\p{N}])(?:AKIA|ghp_|sk-)[\w-]{12,}+"
    ),
    "card": r"(?=\d)(?<![\p{L}\p{N}])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![\p{L}\p{N}])(?!\.\d)",
    "given": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{_GIVEN})(?= {_NAME})",
    "surname": rf"(?=\p{{Lu}})(?<=(?<!\p{{L}})(?:{_TITLE}|{_GIVEN})\.? ){_NAME}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every entity but names and keys holds a digit or an @, and names follow a title or a given name.
_SIGN = r"[0-9@]"
_WORD_SIGN = rf"(?=[\p{{Lu}}gs])(?<!\p{{L}})(?:(?:{_TITLE}|{_GIVEN})\.? \p{{Lu}}|AKIA|ghp_|sk-)|(?=[a-fA-F])(?<![\p{{L}}\p{{N}}])[a-fA-F]{{24}}"

#: Set around each mention; where a text holds them itself, they are written with the escape before.
_MARK, _ESCAPE = "\x01", "\x02"


def has_entity(text: Column) -> Column:
    """Whether a text holds anything like an entity (null: no).  Texts without a sign of one are told by a short look."""
    return F.coalesce((text.rlike(_SIGN) | text.rlike(_WORD_SIGN)) & text.rlike(ANY), F.lit(False))


def mentions(text: Column) -> Column:
    """All mentions in a text, in order, as they are written."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def pieces(text: Column) -> Column:
    """The text in pieces, in one pass: those at even places (from 1) are the mentions, as they are written."""
    safe = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(f"{_ESCAPE}!")), F.lit(_MARK), F.lit(f"{_ESCAPE}?"))
    return F.split(F.regexp_replace(safe, f"({ANY})", f"{_MARK}$1{_MARK}"), _MARK, -1)


def _unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(f"{_ESCAPE}?"), F.lit(_MARK)), F.lit(f"{_ESCAPE}!"), F.lit(_ESCAPE))


def kind_of(mention: Column) -> Column:
    """The kind of a mention, from its own characters; null for a number like a card's whose check digit is wrong."""
    digits = F.length(F.regexp_replace(mention, r"\D", ""))
    card = mention.rlike(r"^[\d -]+$") & (digits >= 13)
    return (
        F.when(mention.contains("@"), "email")
        .when(mention.rlike(rf"^(?:{PATTERNS['ip']})$"), "ip")
        .when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(mention.rlike(rf"^(?:{PATTERNS['phone']})$"), "phone")
        .when(card & F.call_function("luhn_check", F.regexp_replace(mention, r"\D", "")), "card")
        .when(card, F.lit(None).cast("string"))
        .when(mention.rlike(r"\d") | mention.rlike(r"^(?:[a-fA-F]{24,}|(?:AKIA|ghp_|sk-).*)$"), "secret")
        .when(F.lower(mention).isin([n.lower() for n in _ALL_GIVEN]), "given")
        .otherwise("surname")
    )


def canonical(mention: Column, kind: Column) -> Column:
    """What mentions of one entity have in common: digits alone, or lower case; of Cyrillic surnames the masculine form."""
    lower = F.lower(mention)
    masculine = F.regexp_replace(F.regexp_replace(lower, "([сц]к)ая$", "$1ий"), "(ов|ев|ёв|ин|ын)а$", "$1")
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(mention, r"\D", ""))
        .when((kind == "surname") & lower.rlike(r"\p{IsCyrillic}$"), masculine)
        .otherwise(lower)
    )


def _draw(stream: Column, i: Column) -> Column:
    """The i-th (from 1) number, 0 to 65535, of a hexadecimal stream of 64 of them."""
    return F.conv(F.substr(stream, F.pmod(i - 1, F.lit(64)) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(n, F.lit(len(words))) + 1).cast("int"))


def _characters(text: Column) -> Column:
    """The characters of a text as an array: to take them one by one from the text would be quadratic."""
    return F.split(text, "")


def _written(word: Column, stream: Column) -> Column:
    """``word`` with each digit replaced by a digit and each letter by a letter of its script."""

    def one(ch: Column, i: Column) -> Column:
        n = _draw(stream, i + 1)
        code = F.lit(None).cast("int")
        for script, (first, size) in SCRIPTS.items():
            code = F.when(ch.rlike(rf"\p{{Is{script}}}"), F.pmod(n, F.lit(size)) + first).otherwise(code)
        # Letters of any other script become Latin ones.
        code = F.coalesce(code, F.pmod(n, F.lit(26)) + 0x61)
        letter = F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
        return F.when(ch.rlike(r"\d"), F.pmod(n, F.lit(10)).cast("string")).when(ch.rlike(r"\p{L}"), letter).otherwise(ch)

    return F.array_join(F.transform(_characters(word), one), "")


def _hex(word: Column, stream: Column) -> Column:
    one = lambda i: F.lower(F.hex(F.pmod(_draw(stream, i), F.lit(16))))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(word)), one), "")


def _syllables(syllables: list[str], parts: Column, each: Column, stream: Column) -> Column:
    """``parts`` words of ``each`` syllables, joined by hyphens."""

    def part(p: Column) -> Column:
        drawn = F.sequence((p - 1) * each + 1, p * each)
        return F.array_join(F.transform(drawn, lambda i: _pick(syllables, _draw(stream, i))), "")

    return F.array_join(F.transform(F.sequence(F.lit(1), parts), part), "-")


def luhn_digit(digits: Column) -> Column:
    """The check digit that completes ``digits``."""
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(F.pmod(n - i, F.lit(2)) == 0, doubled).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), part), F.lit(0), lambda a, b: a + b)
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def with_streams(entities: DataFrame, key: str) -> DataFrame:
    """``entities(kind, entity, attempt)`` with the keyed hashes that :func:`surrogate` draws from.

    Checkpointed, so that a hash is computed once and not for each character that is drawn from it.
    """
    keyed = lambda *x: F.sha2(F.concat_ws("\x1f", F.lit(key), F.col("kind"), *x), 512)
    host = F.when(F.col("kind") == "email", F.regexp_replace(F.substring_index("entity", "@", -1), r"\.[^.]*$", ""))
    again = F.col("attempt").cast("string")
    return checkpointed(
        entities.withColumns(
            {
                "_stream": F.concat(keyed(F.col("entity"), again, F.lit("a")), keyed(F.col("entity"), again, F.lit("b"))),
                "_host": host,
                "_of_host": F.when(host.isNotNull(), F.concat(keyed(host, F.lit("a")), keyed(host, F.lit("b")))),
            }
        )
    )


#: Attempts after which surrogates grow by one character with each further one, so that no space can run out.
GROW_LOCAL, GROW = 2, 5


def surrogate() -> Column:
    """A replacement of the same kind for a row of :func:`with_streams`, in the form of :func:`canonical`.

    An e-mail keeps its shape and script and ends in the reserved domain ``example``; its domain depends on the original
    domain alone, so that addresses of one domain stay together.  IP addresses stay valid addresses; phone
    numbers keep their first digit, cards too, and their check digit is right; secrets keep length, alphabet and known prefix; given names keep gender and script, surnames the script, their
    number of parts and, in Cyrillic and Greek, the ending that tells gender.

    Where the draws keep colliding, texts and numbers grow longer with each further attempt, names from the first one on;
    IPv4 addresses become IPv6 ones of the documentation prefix.
    """
    kind, entity, attempt = F.col("kind"), F.col("entity"), F.col("attempt")
    stream, host, of_domain = F.col("_stream"), F.col("_host"), F.col("_of_host")
    more = lambda filler, after: F.repeat(F.lit(filler), F.greatest(attempt - after, F.lit(0)))
    local = F.concat(F.substring_index(entity, "@", 1), more("a", GROW_LOCAL))
    octet = lambda i, low, n: (F.pmod(_draw(stream, F.lit(i)), F.lit(n)) + low).cast("string")
    v4 = F.concat_ws(".", octet(1, 1, 223), octet(2, 0, 256), octet(3, 0, 256), octet(4, 1, 254))
    v6 = F.concat_ws(":", F.lit("2001:db8"), *[F.lower(F.hex(_draw(stream, F.lit(i)))) for i in range(1, 7)])
    first, size = F.substr(entity, F.lit(1), F.lit(1)), F.length(entity)
    body = F.concat(first, _written(F.concat(F.substr(entity, F.lit(2), size - 1), more("0", GROW)), stream))
    card = F.substr(body, F.lit(1), F.length(body) - 1)
    prefix = F.regexp_extract(entity, "^(akia|ghp_|sk-|)", 1)
    token = F.concat(F.substr(entity, F.length(prefix) + 1), more("a", GROW))
    secret = F.when(entity.rlike("^[0-9a-f]+$"), _hex(token, stream)).otherwise(F.concat(prefix, _written(token, stream)))

    names = F.lit(None).cast("string")
    for known in GIVEN.values():
        known = known.lower().split()
        names = F.when(entity.isin(known), _pick(known, _draw(stream, F.lit(1)))).otherwise(names)
    ending = F.when(attempt > 0, _written(F.repeat(F.substr(entity, F.lit(2), F.lit(1)), 4), stream)).otherwise("")
    parts = F.size(F.split(entity, "-"))
    surnames = _written(F.concat(entity, F.repeat(F.substr(entity, F.lit(1), F.lit(1)), attempt)), stream)
    for script, syllables in SYLLABLES.items():
        surnames = F.when(entity.rlike(rf"^\p{{Is{script}}}"), _syllables(syllables.split(), parts, attempt + 3, stream)).otherwise(surnames)
    gender = F.when(entity.rlike(r"^[\p{IsCyrillic}-]{4,}$"), F.regexp_extract(entity, "(?:ов|ев|ёв|ин|ын|[сц]кий)$", 0))
    gender = gender.when(entity.rlike(r"^[\p{IsGreek}-]{4,}$"), F.regexp_extract(entity, "(?:ος|ου|ης|ας|η|α)$", 0)).otherwise("")
    return (
        F.when(kind == "email", F.concat(_written(local, stream), F.lit("@"), _written(host, of_domain), F.lit(".example")))
        .when(kind == "ip", F.when(attempt <= GROW, v4).otherwise(v6))
        .when(kind == "card", F.concat(card, luhn_digit(card)))
        .when(kind == "secret", secret)
        .when(kind == "given", F.concat(names, ending))
        .when(kind == "surname", F.concat(surnames, gender))
        .otherwise(body)
    )


def shaped(mention: Column, kind: Column, new: Column) -> Column:
    """The surrogate written as the mention is: its separators, its capitals, its gender."""
    upper = (F.upper(mention) == mention) & (F.lower(mention) != mention)

    def spaced(i: Column) -> Column:
        ch = F.substr(mention, i, F.lit(1))
        so_far = F.length(F.regexp_replace(F.substr(mention, F.lit(1), i), r"\D", ""))
        return F.when(ch.rlike(r"\d"), F.substr(new, so_far, F.lit(1))).otherwise(ch)

    def cased(old: Column, ch: Column) -> Column:
        return F.when(old.rlike(r"\p{Lu}"), F.upper(ch)).otherwise(ch)

    rest = F.substr(new, F.length(F.regexp_replace(mention, r"\D", "")) + 1)
    grouped = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.length(mention)), spaced), ""), rest)
    feminine = (kind == "surname") & F.lower(mention).rlike("(?:[сц]кая|(?:ов|ев|ёв|ин|ын)а)$")
    name = F.when(feminine, F.when(new.endswith("ий"), F.regexp_replace(new, "ий$", "ая")).otherwise(F.concat(new, F.lit("а")))).otherwise(new)
    capital = lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))
    return (
        F.when(kind.isin("phone", "card", "ssn"), grouped)
        .when(kind.isin("given", "surname"), F.when(upper, F.upper(name)).otherwise(F.array_join(F.transform(F.split(name, "-"), capital), "-")))
        .when(upper & kind.isin("email", "secret"), F.upper(new))
        .when(kind.isin("email", "secret"), F.array_join(F.zip_with(_characters(mention), _characters(new), cased), ""))
        .otherwise(new)
    )


def assign(entities: DataFrame, key: str, max_rounds: int = 50) -> DataFrame:
    """``(kind, entity, new)``: a surrogate of its own for each of the distinct ``entities(kind, entity)``.

    A surrogate that two entities share, or that is itself an entity of the corpus, is drawn
    again for all but the first (by attempt, then by name) until none is left.
    """
    drawn = with_streams(entities.withColumn("attempt", F.lit(0)), key)
    placed = checkpointed(drawn.select("kind", "entity", "attempt", surrogate().alias("new")))
    real = placed.select("kind", F.col("entity").alias("new"), F.lit(True).alias("real"))
    for _ in range(max_rounds):
        owner = placed.groupBy("kind", "new").agg(F.min(F.struct("attempt", "entity")).alias("owner"), F.count(F.lit(1)).alias("n"))
        taken = checkpointed(owner.join(real, ["kind", "new"], "left").where("n > 1 OR real").select("kind", "new", "owner", "real"))
        if taken.isEmpty():
            return placed.select("kind", "entity", "new")
        again = F.col("owner").isNotNull() & (F.col("real").isNotNull() | (F.col("owner.entity") != F.col("entity")))
        marked = checkpointed(placed.join(taken, ["kind", "new"], "left").withColumn("again", again))
        losers = marked.where("again").select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
        drawn = with_streams(losers, key).select("kind", "entity", "attempt", surrogate().alias("new"))
        placed = checkpointed(marked.where("NOT again").select("kind", "entity", "attempt", "new").unionAll(drawn))
    raise RuntimeError(f"surrogates still collide after {max_rounds} rounds")


_KEY = ("_k1", "_k2")


def replace_entities(docs: DataFrame, key: str = "weftline") -> DataFrame:
    """``docs`` with every detected entity in ``text`` replaced, and ``n_replaced``; one row for each row.

    The same entity gets the same surrogate in every text and every way of writing it (separators of numbers,
    capitals, gender), different entities get different ones, and without the ``key`` they can't be
    told.  Null texts stay null with 0 replaced; empty texts and texts without entities stay as they are;
    repeated rows stay repeated.  All other columns are kept, but an ``n_replaced`` of the input is replaced.

    Texts with entities are cut into pieces once and stored; equal texts, told by 128 bits, are worked on once.
    """
    g = Guarded(docs.drop("n_replaced"))
    text = F.col(g["text"])
    without = g.df.where(~has_entity(text))
    # Generated rows, not a filter over the pieces: that would cut the texts twice.
    looks = F.coalesce(text.rlike(_SIGN) | text.rlike(_WORD_SIGN), F.lit(False))
    cut = F.filter(F.array(F.struct(F.when(looks, pieces(text)).alias("_pieces"))), lambda x: F.size(x["_pieces"]) > 1)
    with_any = g.df.select("*", F.inline(cut)).withColumns({"_k1": F.xxhash64(text), "_k2": F.xxhash64(F.lit(1), text)})
    with_any = stored(with_any.select(*[c for c in g.df.columns if c != g["text"]], "_pieces", *_KEY))

    once = with_any.select(*_KEY, "_pieces").dropDuplicates(list(_KEY))
    said = once.select(*_KEY, F.posexplode("_pieces").alias("at", "mention")).where("at % 2 = 1").withColumn("kind", kind_of(F.col("mention")))
    said = stored(said.withColumn("entity", canonical(F.col("mention"), F.col("kind"))))
    news = checkpointed(assign(said.where("kind IS NOT NULL").select("kind", "entity").distinct(), key))
    written = F.coalesce(shaped(F.col("mention"), F.col("kind"), F.col("new")), "mention")
    told = said.join(news, ["kind", "entity"], "left").select(*_KEY, F.struct("at", written.alias("new")).alias("one"), "kind")
    told = checkpointed(told.groupBy(*_KEY).agg(F.array_sort(F.collect_list("one")).alias("_new"), F.count("kind").alias("_n")))
    plain = F.transform(F.filter("_pieces", lambda p, i: i % 2 == 0), _unescaped)
    joined = F.array_join(F.zip_with(plain, "_new", lambda a, b: F.concat(a, F.coalesce(b["new"], F.lit("")))), "")
    done = with_any.join(told, list(_KEY)).select(
        *[F.col(c) if c != g["text"] else joined.alias(c) for c in g.df.columns],
        F.col("_n").alias("n_replaced"),
    )
    return done.unionAll(without.withColumn("n_replaced", F.lit(0).cast("long"))).toDF(*g.names, "n_replaced")
