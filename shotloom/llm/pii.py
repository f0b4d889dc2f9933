"""Op 9, PII surrogates, with DataFrame and SQL functions only.

Mentions are found by pattern, reduced to entities (type and normal form), and
every entity gets one keyed surrogate for the whole corpus, so mentions of the
same entity stay the same and different entities stay different: a surrogate that
meets another one, or a real entity, is drawn again. Each mention is then rendered
in its own format: digits stay digits, letters keep case and script, names keep
script and gender. A person is found by a title; the full name without a title is
then replaced wherever else the same document has it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.llm.base import discard, stored

#: Fixed patterns by type, in the order in which they are tried.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_FEMALE = r"(?:Mrs|Ms|Miss|Madame|Mme|Frau|Señora|Sra|Signora|Mevrouw|госпожа|г-жа|κυρία)"
_MALE = r"(?:Mr|Monsieur|Herr|Señor|Sr|Signor|Meneer|господин|г-н|κύριος)"
_NEUTRAL = r"(?:Dr|Prof)"
_TITLE = rf"(?:{_FEMALE}|{_MALE}|{_NEUTRAL})"
_LINK = r"(?:(?:van|von|vom|zu|zur|der|den|de|del|della|di|da|dos|du|la|le|bin|ibn|ten|ter) )"
#: Initials before another name, or a name with inner capitals, hyphens and apostrophes (not a possessive s).
_NAME = (rf"(?:(?:\p{{Lu}}\.){{1,4}}(?= (?:\p{{Lu}}|{_LINK}))"
         r"|(?:\p{Lu}\.){0,4}\p{Lu}[\p{L}\p{M}]*+(?:(?:['’](?!s(?![\p{L}\p{M}]))|-)[\p{L}\p{M}]++)*+)")
_PIECE = rf"{_LINK}*+{_NAME}"
_FULL = rf"{_PIECE}(?: {_PIECE})*+"
#: Values after a key word: eight characters or more, inner punctuation included.
_KEYWORD = r"(?i:token|password|passwd|passphrase|pwd|secret|(?:api|access|secret|private)[_\-]?key)"
_VALUE = (r"(?=[^\s\"'<>,;]{8})[!@#$%^&*~]*+[A-Za-z0-9+/_\-]++"
          r"(?:(?:[.=~!@#$%^*:]|&(?!\w{1,30}=))++[A-Za-z0-9+/_\-]++)*+={0,2}+")
_GROUPED = "|".join(f"[0-9]{{4}}(?:{s}[0-9]{{4}}){{3}}(?:{s}[0-9]{{1,3}})?|[0-9]{{4}}(?:{s}[0-9]{{4}}){{2}}{s}[0-9]{{1,3}}"
                    f"|[0-9]{{4}}{s}[0-9]{{6}}{s}[0-9]{{4,5}}" for s in " -")
PATTERNS = {
    "EMAIL": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)+",
    "SECRET": rf"(?<=[=:\s\"'])(?<={_KEYWORD}[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?){_VALUE}"
              r"|(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "IBAN": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "CARD": rf"(?<![\w.\-])(?:[0-9]{{13,19}}|{_GROUPED})(?![\w\-])",
    "SSN": r"(?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-])",
    "PHONE": r"(?<![\w.+\-])(?:(?:(?:\+[0-9]{1,3}|1)[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}"
             r"|\+[0-9](?:[ .\-]?(?:\([0-9]{1,4}\)|[0-9])){6,14}"
             r"|00[1-9][0-9]{0,2}(?:[ .\-]\(?[0-9]{1,4}\)?){1,2}(?:[ .\-]?[0-9]){5,9}"
             r"|0[1-9][0-9]{1,3}[ /\-][0-9]{3,4}[ \-]?[0-9]{3,4})(?![\w\-])",
    "IP": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w)(?!\.[0-9])",
    "PERSON": rf"(?<!\p{{L}})(?:{_TITLE}\.? )++{_FULL}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every mention holds, cheap to look for.
HINT = rf"[0-9@]|(?i:token|passw|passphrase|pwd|secret|key[\"']?\s{{0,3}}[=:])|AKIA|{_TITLE}\.? \p{{Lu}}"
_EDGES = r"(?<![\p{L}\p{M}])", r"(?![\p{L}\p{M}])"

#: Fixed given names by script and gender; family names are made from syllables.
GIVEN = {
    ("latin", "f"): "Anna Clara Diana Elena Flora Greta Helena Irene Julia Karin Laura Maria Nora Olivia Paula Rosa "
                    "Sara Teresa Vera Zelda",
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noel Oscar Paul Robert "
                    "Simon Tomas Victor",
    ("latin", "n"): "Alex Robin Sascha Kim Andrea Dominique Charlie Noa Jules Sam",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Зоя Ирина Лидия Мария Нина Ольга Полина Раиса София Тамара",
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Леонид Максим Никита Олег Павел Роман",
    ("cyrillic", "n"): "Саша Женя Валя",
    ("greek", "f"): "Άννα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Όλγα Σοφία Χριστίνα",
    ("greek", "m"): "Αντώνης Γιώργος Δημήτρης Ηλίας Κώστας Μάριος Νίκος Παύλος Στέφανος Χρήστος",
    ("greek", "n"): "Αλέξης Γιάννα Μάνος",
}
SYLLABLES = {
    "latin": "bal cor den fal gar hol jen kor lam mer nor pel ros sal tor val wes zan bri dal".split(),
    "cyrillic": "бал вер гор дан жел зор кам лес мир нов пол руд сал тих фед хар чер шум ягод яр".split(),
    "greek": "αλ βασ γερ δελ ζαν θεο καρ λαμ μαρ νικ παπ ρουσ σταμ τσιρ φιλ χαρ ψαρ μεσ κον βαλ".split(),
}
SUFFIX = {"latin": "man", "cyrillic": "ин", "greek": "άκης"}


def _type_of(mention: Column) -> Column:
    """The first type whose pattern fits the whole mention; what only its surroundings tell is SECRET.

    Null for a number with the digits of a card but neither its 16 digits nor its check digit.
    """
    out = F.when(F.regexp_like(mention, F.lit(rf"^{_PIECE}(?: {_PIECE})++$")), "PERSON").otherwise("SECRET")
    for kind in reversed([k for k in PATTERNS if k != "SECRET"]):
        out = F.when(F.regexp_like(mention, F.lit(rf"^(?:{PATTERNS[kind]})$")), F.lit(kind)).otherwise(out)
    digits = F.regexp_replace(mention, "[^0-9]", "")
    return F.when((out != "CARD") | (F.length(digits) == 16) | (_luhn_sum(digits) % 10 == 0), out)


def _full_names(mentions: Column) -> Column:
    """Distinct full names behind a document's titles, longest first; also first and last name without what is between."""
    full = F.transform(mentions, lambda m: F.regexp_extract(
        m, rf"^(?:{_TITLE}\.? )++({_PIECE}(?: {_PIECE})++)$", 1))
    ends = F.transform(full, lambda f: F.regexp_replace(
        f, rf"^({_PIECE})(?: {_PIECE})+? ({_PIECE})$", "$1 $2"))
    names = F.array_distinct(F.filter(F.concat(full, ends), lambda f: f != ""))
    by_length = F.array_sort(F.transform(names, lambda f: F.struct((-F.length(f)).alias("l"), f.alias("f"))))
    return by_length["f"]


def _script(name: Column) -> Column:
    return (F.when(F.regexp_like(name, F.lit(r"^\p{IsCyrillic}")), "cyrillic")
            .when(F.regexp_like(name, F.lit(r"^\p{IsGreek}")), "greek").otherwise("latin"))


def _pick(options: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (at % len(options) + 1).cast("int"))


def _byte(i: Column) -> Column:
    """The i-th keyed byte (from 0) of the entity's ``stream`` of hex digits, repeated as needed."""
    return F.conv(F.substr("stream", (i % 96) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _masked(value: Column, hexadecimal: Column) -> Column:
    """Every digit, lower and upper letter replaced by one of its kind; the rest stays."""
    def one(c: Column, i: Column) -> Column:
        b = _byte(i)
        low = F.when(hexadecimal, F.substr(F.lit("abcdef"), b % 6 + 1, F.lit(1))) \
            .otherwise(F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), b % 26 + 1, F.lit(1)))
        return (F.when(c.between("0", "9"), (b % 10).cast("string")).when(c.between("a", "z"), low)
                .when(c.between("A", "Z"), F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), b % 26 + 1, F.lit(1)))
                .otherwise(c))

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string."""
    parts = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == 0, c.try_cast("int")).otherwise((c.try_cast("int") * 2) % 10 + F.floor(c.try_cast("int") / 5).cast("int")))
    return F.aggregate(parts, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def _more(alphabet: str) -> Column:
    """Extra characters of late attempts, one more every fourth: a shape with too few values never runs out."""
    some = F.transform(F.sequence(F.lit(0), F.floor(F.col("attempt") / 4).cast("int")),
                       lambda i: F.when(i > 0, F.substr(F.lit(alphabet), _byte(i + 63) % len(alphabet) + 1, F.lit(1))).otherwise(""))
    return F.array_join(some, "")


def _card(norm: Column, masked: Column) -> Column:
    """A number with the same first digit whose check digit is right exactly if the original's was."""
    body = F.concat(F.substr(norm, F.lit(1), F.lit(1)), F.substr(masked, F.lit(2), F.length(norm) - 2), _more("0123456789"))
    right = F.pmod(F.lit(10) - _luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10))
    wrong = (right + 1 + _byte(F.lit(95)) % 9) % 10
    return F.concat(body, F.when(_luhn_sum(norm) % 10 == 0, right).otherwise(wrong).cast("string"))


def _family(script: str) -> Column:
    """Capitalised syllables from keyed bytes; later attempts are longer, so names never run out."""
    syl = F.array(*map(F.lit, SYLLABLES[script]))
    parts = F.transform(F.sequence(F.lit(1), F.lit(2) + F.least(F.col("attempt"), F.lit(20))),
                        lambda i: F.element_at(syl, (_byte(i) % len(SYLLABLES[script]) + 1).cast("int")))
    return F.initcap(F.concat(F.array_join(parts, ""), F.lit(SUFFIX[script])))


def _given(script: str, gender: str) -> Column:
    """A listed name; attempts beyond the third join several of them by hyphens."""
    names = F.array(*map(F.lit, GIVEN[(script, gender)].split()))
    n = len(GIVEN[(script, gender)].split())
    parts = F.transform(F.sequence(F.lit(1), F.lit(1) + F.floor(F.col("attempt") / 3).cast("int")),
                        lambda i: F.element_at(names, (_byte(i) % n + 1).cast("int")))
    return F.array_join(parts, "-")


def _draw(key: str) -> Column:
    """The surrogate of an entity ``(type, norm)`` at its ``attempt``, in normal form."""
    norm, masked = F.col("norm"), _masked(F.col("norm"), F.regexp_like("norm", F.lit("^[0-9a-f]+$")))
    octets = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_byte(i) % 254 + 1).cast("string"))
    tld = F.regexp_extract("norm", r"(\.[^.@]*)$", 1)
    out = (F.when(F.col("type") == "EMAIL",
                  F.concat(_more("abcdefghijklmnopqrstuvwxyz"), F.substr(masked, F.lit(1), F.length("norm") - F.length(tld)), tld))
           .when(F.col("type") == "CARD", _card(norm, masked))
           .when(F.col("type") == "IP", F.array_join(octets, "."))
           .when(F.col("type") == "PHONE", F.concat(
               (_byte(F.lit(0)) % 8 + 2).cast("string"), F.substr(masked, F.lit(2), F.length("norm")), _more("0123456789")))
           .when(F.col("type") == "IBAN", F.concat(F.substr(norm, F.lit(1), F.lit(2)),
                                                   F.substr(masked, F.lit(3), F.length("norm")), _more("0123456789")))
           .when((F.col("type") == "SECRET") & norm.startswith("AKIA"),
                 F.concat(F.lit("AKIA"), F.substr(masked, F.lit(5), F.length("norm")), _more("0123456789"))))
    for (script, gender) in GIVEN:
        out = out.when((F.col("type") == f"GIVEN {script}") & (F.col("gender") == gender), _given(script, gender))
    for script in SYLLABLES:
        out = out.when(F.col("type") == f"FAMILY {script}", _family(script))
    return out.otherwise(F.concat(masked, _more("0123456789")))


def _stream(key: str) -> Column:
    seed = F.concat_ws("|", F.lit(key), F.col("type"), F.col("attempt").cast("string"), F.col("norm"))
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{k}")), 256) for k in range(3)])


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``(type, norm, surrogate)``: one per entity, all distinct within a type and none a real entity.

    Each round draws for the entities still open; of those that draw the same, the
    first keeps it, and draws that meet a kept surrogate or a real entity go again.
    An entity's gender is the one that its titles agree on, else neutral.
    """
    female, male = F.bool_or(F.col("gender") == "f"), F.bool_or(F.col("gender") == "m")
    gender = F.when(female & ~male, "f").when(male & ~female, "m").otherwise("n")
    real = stored(entities.groupBy("type", "norm").agg(gender.alias("gender")), "pii-real")
    taken = real.select("type", F.lower("norm").alias("low")).distinct()
    attempt, kept, open_ = 0, None, real
    while True:
        drawn = (open_.withColumn("attempt", F.lit(attempt)).withColumn("stream", _stream(key))
                 .withColumn("surrogate", _draw(key)).select("type", "norm", "surrogate"))
        first = drawn.groupBy("type", "surrogate").agg(F.min("norm").alias("norm"))
        good = first.withColumn("low", F.lower("surrogate")).join(taken, ["type", "low"], "left_anti")
        if kept is not None:
            good = good.join(kept.select("type", "surrogate"), ["type", "surrogate"], "left_anti")
        good = good.select("type", "norm", "surrogate")
        new_kept = stored(good if kept is None else kept.union(good), "pii-map")
        rest = stored(open_.join(new_kept, ["type", "norm"], "left_anti"), "pii-open")
        for old in ([kept] if kept is not None else []) + ([open_] if attempt else []):
            discard(old)
        kept, open_, attempt = new_kept, rest, attempt + 1
        if open_.isEmpty():
            return kept


def _parts(mentions: DataFrame) -> DataFrame:
    """Entities behind each distinct mention: ``(mention, kind, type, part, lead, piece, norm, gender)``.

    Names are one entity whatever their case. A mention that is none has a null kind
    and no row here.
    """
    m = F.col("mention")
    digits = F.regexp_replace(m, "[^0-9]", "")
    titles = F.regexp_extract(m, rf"^((?:{_TITLE}\.? )*+)", 1)
    pieces = F.regexp_extract_all(F.substr(m, F.length(titles) + 1, F.length(m)), F.lit(_PIECE), F.lit(0))
    gender = (F.when(F.regexp_like(titles, F.lit(rf"(?<!\p{{L}}){_FEMALE}\.? ")), "f")
              .when(F.regexp_like(titles, F.lit(rf"(?<!\p{{L}}){_MALE}\.? ")), "m").otherwise("n"))
    plain = F.array(F.struct(
        F.col("kind").alias("type"), F.lit(0).alias("part"), F.lit("").alias("lead"), m.alias("piece"),
        F.when(F.col("kind") == "EMAIL", F.lower(m)).when(F.col("kind").isin("CARD", "SSN"), digits)
        .when(F.col("kind") == "PHONE", F.substr(digits, F.greatest(F.lit(1), F.length(digits) - 9), F.lit(10)))
        .when(F.col("kind") == "IBAN", F.regexp_replace(m, " ", "")).otherwise(m).alias("norm"),
        F.lit("n").alias("gender")))

    def name(p: Column, i: Column) -> Column:
        lead = F.regexp_extract(p, rf"^({_LINK}*+)", 1)
        own = F.substr(p, F.length(lead) + 1, F.length(p))
        role = F.when(i == F.size("pieces") - 1, "FAMILY ").otherwise("GIVEN ")
        before = F.when(i == 0, F.col("titles")).otherwise(F.lit(" "))
        return F.struct(F.concat(role, _script(own)).alias("type"), i.alias("part"), F.concat(before, lead).alias("lead"),
                        own.alias("piece"), F.lower(own).alias("norm"), F.col("gender"))

    return (mentions.withColumn("kind", _type_of(m)).filter("kind is not null")
            .withColumn("titles", titles).withColumn("pieces", pieces).withColumn("gender", gender)
            .withColumn("e", F.explode_outer(F.when(F.col("kind") == "PERSON", F.transform("pieces", name)).otherwise(plain)))
            .select("mention", "kind", "e.*"))


def _render(kind: Column, piece: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's own format; what a late attempt has in excess goes in front."""
    def after(i: Column) -> Column:
        return F.length(F.regexp_replace(F.substr(piece, i + 2, F.length(piece)), "[^0-9A-Z]", ""))

    laid = F.array_join(F.transform(F.split(piece, ""), lambda c, i: F.when(
        F.regexp_like(c, F.lit("[0-9A-Z]")) & (after(i) < F.length(surrogate)),
        F.substr(surrogate, F.length(surrogate) - after(i), F.lit(1))).otherwise(c)), "")
    places = F.length(F.regexp_replace(piece, "[^0-9A-Z]", ""))
    laid = F.concat(F.substr(surrogate, F.lit(1), F.greatest(F.lit(0), F.length(surrogate) - places)), laid)
    upper = (piece == F.upper(piece)) & ((kind == "EMAIL") | (kind == "PERSON")
                                         & F.regexp_like(piece, F.lit(r"\p{L}\P{L}*\p{L}")))
    return (F.when(kind.isin("CARD", "SSN", "PHONE", "IBAN"), laid)
            .when(upper, F.upper(surrogate)).otherwise(surrogate))


def replace_entities(docs: DataFrame, key: str = "surrogates") -> DataFrame:
    """``docs`` with every detected entity replaced, plus ``entities array<struct<type, surrogate>>``.

    Documents without a mention (null and empty texts too) keep their text and get
    an empty list. Other columns pass through, whatever their names; an ``entities``
    column of the input is replaced. Repeated rows are replaced alike.
    """
    docs = docs.drop("entities")
    tag = f"_{uuid.uuid4().hex[:8]}"
    rid, found, also = f"rid{tag}", f"found{tag}", f"also{tag}"
    hint = F.coalesce(F.regexp_like("text", F.lit(HINT)), F.lit(False))
    mentions = F.when(hint, F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    # a document's own full names are looked for beside the fixed patterns, which go first
    names = _full_names(F.col(found))
    quoted = F.array_join(F.transform(names, lambda f: F.concat(F.lit(r"\Q"), f, F.lit(r"\E"))), "|")
    full = F.concat(F.lit(f"{ANY}|{_EDGES[0]}(?:"), F.col(also), F.lit(f"){_EDGES[1]}"))
    pattern = F.when(F.col(also) == "", F.lit(ANY)).otherwise(full)
    hits = docs.withColumn(found, mentions).filter(F.size(found) > 0).withColumn(also, quoted)
    hits = stored(hits.withColumn(found, F.when(F.col(also) == "", F.col(found)).otherwise(
        F.regexp_extract_all("text", full, F.lit(0)))).withColumn(rid, F.monotonically_increasing_id()), "pii-hits")
    places = hits.select(rid, F.posexplode(found).alias("pos", "mention"))
    parts = stored(_parts(places.select("mention").distinct()), "pii-parts")
    chosen = surrogates(parts, key)
    rendered = (parts.join(chosen, ["type", "norm"])
                .withColumn("piece", _render(F.col("kind"), F.col("piece"), F.col("surrogate")))
                .groupBy("mention").agg(F.first("kind").alias("kind"),
                                        F.sort_array(F.collect_list(F.struct("part", "lead", "piece"))).alias("pieces"))
                .select("mention", "kind", F.array_join(F.flatten(F.transform(
                    "pieces", lambda p: F.array(p["lead"], p["piece"]))), "").alias("out")))
    by_row = (places.join(rendered, "mention", "left").withColumn("out", F.coalesce("out", "mention")).groupBy(rid)
              .agg(F.sort_array(F.collect_list(F.struct("pos", "kind", "out"))).alias(f"new{tag}")))
    gaps = F.split("text", pattern, -1)
    new = F.col(f"new{tag}")
    text = F.array_join(F.flatten(F.zip_with(gaps, F.concat(new["out"], F.array(F.lit(""))),
                                             lambda g, s: F.array(g, s))), "")
    entities = F.transform(F.filter(new, lambda x: x["kind"].isNotNull()),
                           lambda x: F.struct(x["kind"].alias("type"), x["out"].alias("surrogate")))
    changed = hits.join(by_row, rid).withColumn("entities", entities).withColumn("text", text)
    clean = docs.filter(~hint | ~F.coalesce(F.regexp_like("text", F.lit(ANY)), F.lit(False)))
    none = F.array().cast("array<struct<type:string,surrogate:string>>")
    return changed.select(*docs.columns, "entities").unionByName(clean.withColumn("entities", none))
