"""Deterministic corruptions of names for benchmarks: the choice at each step is a hash of (key, step, seed), never a row's place.

Each operation takes (text, key, step) and uses its text several times, so operations in a row are columns of their
own: see mutate(), which applies a named pipeline to a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.normalize import fixed, latin_dominant, squeeze, unicode_tokens

# What bank transfers add to a name.
NOISE_SUFFIXES = ("FATURA ODEMESI", "EFT ODEMESI", "HAVALE BEDELI", "ODEME", "FATURA", "ODM", "EFT REF 381729", "HAVALE REF 729184")
NOISE = ("ODM", "ODEME", "FATURA ODEMESI", "HAVALE", "EFT", "MAL BEDELI", "HIZMET BEDELI", "SIPARIS ODEMESI")
# Words of legal forms.
LEGAL_TOKENS = (
    "A AS AŞ ANONIM ANONİM SIRKET ŞİRKET SIRKETI ŞİRKETİ LIMITED LİMİTED LTD LLC LP INC CORP CORPORATION COMPANY CO GMBH BV NV SAS SA PLC HOLDING HOLDİNG"
).split()
# Characters that are taken for each other.
CONFUSABLE = {"A": "E", "E": "A", "I": "İ", "İ": "I", "O": "U", "U": "O", "S": "Ş", "Ş": "S", "C": "Ç", "Ç": "C", "G": "Ğ", "Ğ": "G", "K": "G", "T": "D", "B": "P", "P": "B"}
VOWELS = "aeıioöuüAEIİOÖUÜ"


def choice(key: Column, n: Column | int, salt: str | Column, seed: int = 42) -> Column:
    """A whole number below n, from the first 15 hex digits of an md5, so that other engines can follow it."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    h = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), salt, F.lit(seed))), 1, 15), 16, 10).cast("long")
    return F.pmod(h, F.greatest(F.lit(1), F.lit(n) if isinstance(n, int) else n).cast("long")).cast("int")


def one_of(values: tuple[str, ...] | list[str], key: Column, salt: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), choice(key, len(values), salt) + 1)


def _at(text: Column, i: Column, n: int | Column = 1) -> Column:
    return F.substr(text, i, F.lit(n) if isinstance(n, int) else n)


def _before(text: Column, i: Column) -> Column:
    """The characters before place i (from 1)."""
    return F.substr(text, F.lit(1), F.greatest(i - 1, F.lit(0)))


def _places(text: Column, good: Callable[[Column], Column]) -> Column:
    """The places (from 1) of which ``good`` holds."""
    return F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: (i <= F.length(text)) & good(i))


def _alnum(c: Column) -> Column:
    return c.rlike(r"^[\p{L}\p{N}]$")


def _pick(values: Column, key: Column, salt: str) -> Column:
    """One of an array's values; null for an empty array."""
    return F.get(values, choice(key, F.size(values), salt))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _legal(word: Column) -> Column:
    return F.upper(word).isin(LEGAL_TOKENS)


def _joined(parts: Column) -> Column:
    return F.array_join(parts, " ")


def delete_character(text: Column, key: Column, step: str = "delete") -> Column:
    """One letter or digit less, if there are more than four."""
    gone = lambda p: F.concat(_before(text, p), F.substr(text, p + 1))
    return _once(_places(text, lambda i: _alnum(_at(text, i))), lambda at: F.when(F.size(at) > 4, _once(_pick(at, key, step), gone)).otherwise(text))


def delete_characters(text: Column, key: Column, step: str = "delete") -> Column:
    """One letter or digit less, or two with probability .4 where there are at least twelve; none where there are at most four."""
    at = _places(text, lambda i: _alnum(_at(text, i)))
    n = F.size(at)
    a = choice(key, n, step)
    b = F.pmod(a + 1 + choice(key, n - 1, f"{step}-second"), n)
    two = (n >= 12) & (choice(key, 10, f"{step}-two") < 4)
    gone = F.when(two, F.array(F.get(at, a), F.get(at, b))).otherwise(F.array(F.get(at, a)))
    left = F.array_join(F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: ~F.array_contains(gone, i)), lambda i: _at(text, i)), "")
    return F.when(n > 4, left).otherwise(text)


def swap_characters(text: Column, key: Column, step: str = "swap", differ: bool = False) -> Column:
    """Two neighbouring letters or digits change places; with ``differ`` only two that differ."""
    places = _places(text, lambda i: _alnum(_at(text, i)) & _alnum(_at(text, i + 1)) & (F.lit(True) if not differ else _at(text, i) != _at(text, i + 1)))
    swapped = lambda p: F.concat(_before(text, p), _at(text, p + 1), _at(text, p), F.substr(text, p + 2))
    return _once(places, lambda at: F.when(F.size(at) > 0, _once(_pick(at, key, step), swapped)).otherwise(text))


def transpose_characters(text: Column, key: Column, step: str = "transpose") -> Column:
    return swap_characters(text, key, step, differ=True)


def remove_vowel(text: Column, key: Column, step: str = "vowel") -> Column:
    """One vowel less that doesn't begin its word, in a word of at least five letters; a character less where there is none."""
    vowel = lambda word: _places(word, lambda i: (i > 1) & _at(word, i).rlike(f"[{VOWELS}]"))
    cut = lambda word: _once(_pick(vowel(word), key, f"{step}-place"), lambda p: F.concat(_before(word, p), F.substr(word, p + 1)))

    def one(words):
        good = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: (F.length(F.get(words, i)) >= 5) & F.substr(F.get(words, i), F.lit(2)).rlike(f"[{VOWELS}]"))
        return _once(_pick(good, key, step), lambda k: F.when(k.isNotNull(), _joined(F.transform(words, lambda w, i: F.when(i == k, cut(w)).otherwise(w)))))

    return F.coalesce(_once(F.filter(F.split(text, r"\s+"), lambda w: w != ""), one), delete_character(text, key, f"{step}-other"))


def drop_vowels(text: Column, key: Column, step: str = "vowels") -> Column:
    """All vowels but the first letter of one word of at least five letters, if three letters are left."""
    words = unicode_tokens(text)
    good = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: F.length(F.get(words, i)) >= 5)
    k = _pick(good, key, step)
    thin = lambda w: F.concat(F.substr(w, F.lit(1), F.lit(1)), F.regexp_replace(F.substr(w, F.lit(2)), f"[{VOWELS}]", ""))
    return F.when(F.size(good) > 0, _joined(F.transform(words, lambda w, i: F.when((i == k) & (F.length(thin(w)) >= 3), thin(w)).otherwise(w)))).otherwise(text)


def abbreviate(text: Column, key: Column | None = None, step: str = "") -> Column:
    """Words of more than four letters cut to .65 of their length, half to even, but not below three."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return _joined(F.transform(words, lambda w: F.when(F.length(w) > 4, F.substr(w, F.lit(1), F.greatest(F.lit(3), F.bround(F.length(w) * 0.65).cast("int")))).otherwise(w)))


def remove_spaces(text: Column, key: Column | None = None, step: str = "") -> Column:
    return F.regexp_replace(text, r"\s+", "")


def join_tokens(text: Column, key: Column | None = None, step: str = "") -> Column:
    """The words without anything between them."""
    return F.array_join(unicode_tokens(text), "")


def merge_tokens(text: Column, key: Column, step: str = "merge") -> Column:
    """Two neighbouring words as one."""
    words = unicode_tokens(text)
    k = choice(key, F.size(words) - 1, step)
    merged = F.concat(F.slice(words, F.lit(1), k), F.array(F.concat(F.get(words, k), F.get(words, k + 1))), F.slice(words, k + 3, F.greatest(F.size(words) - k - 2, F.lit(0))))
    return F.when(F.size(words) >= 2, _joined(merged)).otherwise(F.regexp_replace(text, " ", ""))


def remove_legal(text: Column, key: Column | None = None, step: str = "") -> Column:
    left = _joined(F.filter(unicode_tokens(text), lambda w: ~_legal(w)))
    return F.when(left != "", left).otherwise(text)


def drop_token(text: Column, key: Column, step: str = "drop") -> Column:
    """One word less, of at least four letters and no legal form where there is any such word."""
    words = unicode_tokens(text)
    every = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)))
    good = F.filter(every, lambda i: (F.length(F.get(words, i)) >= 4) & ~_legal(F.get(words, i)))
    k = _pick(F.when(F.size(good) > 0, good).otherwise(every), key, step)
    return F.when(F.size(words) >= 2, _joined(F.filter(words, lambda w, i: i != k))).otherwise(text)


def truncate_tokens(text: Column, key: Column, step: str = "truncate") -> Column:
    """Words of at least five letters cut, each with probability .65, to three to six; if none was, one to at most five."""
    words = unicode_tokens(text)
    good = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: F.length(F.get(words, i)) >= 5)
    salt = lambda i, name: F.concat_ws("-", F.lit(f"{step}-{name}"), i.cast("string"))
    hit = F.filter(good, lambda i: choice(key, 100, salt(i, "hit")) < 65)
    size = lambda w, i: 3 + choice(key, F.least(F.lit(6), F.length(w) - 1) - 2, salt(i, "size"))
    k = _pick(good, key, f"{step}-one")
    cut = lambda w, i: F.when(F.array_contains(hit, i), F.substr(w, F.lit(1), size(w, i))).when((F.size(hit) == 0) & (i == k), F.substr(w, F.lit(1), F.least(F.lit(5), F.length(w) - 1))).otherwise(w)
    return F.when(F.size(good) > 0, _joined(F.transform(words, cut))).otherwise(text)


def shuffle_tokens(text: Column, key: Column, step: str = "shuffle") -> Column:
    """The words in the order of a hash; if that is the same, the first goes last."""
    words = unicode_tokens(text)
    h = lambda i: F.md5(F.concat_ws(":", key.cast("string"), F.lit(step), i.cast("string")))
    mixed = F.transform(F.array_sort(F.transform(words, lambda w, i: F.struct(h(i).alias("h"), i.alias("i"), w.alias("w")))), lambda x: x["w"])
    turned = F.concat(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), F.slice(words, 1, 1))
    return F.when(F.size(words) < 2, text).when(mixed == words, _joined(turned)).otherwise(_joined(mixed))


def confuse(text: Column, key: Column, step: str = "confuse") -> Column:
    """A character becomes the one that it is taken for, in its own case; a character less where there is none."""
    pairs = F.create_map(*(F.lit(x) for kv in CONFUSABLE.items() for x in kv))
    at = _places(text, lambda i: F.upper(_at(text, i)).isin(list(CONFUSABLE)))
    p = _pick(at, key, step)
    c = _at(text, p)
    new = pairs[F.upper(c)]
    new = F.when(c != F.upper(c), F.lower(new)).otherwise(new)
    return F.when(F.size(at) > 0, F.concat(_before(text, p), new, F.substr(text, p + 1))).otherwise(delete_characters(text, key, f"{step}-other"))


def initialism(text: Column, key: Column, step: str = "initials") -> Column:
    """First letters of the words but legal forms, and with probability .5 five letters of the longest word."""
    words = F.filter(unicode_tokens(text), lambda w: ~_legal(w))
    initials = F.array_join(F.transform(words, lambda w: F.substr(w, F.lit(1), F.lit(1))), "")
    longest = F.get(F.filter(words, lambda w: F.length(w) == F.array_max(F.transform(words, lambda x: F.length(x)))), F.lit(0))
    return F.when(F.size(words) < 2, text).when(choice(key, 2, step) == 0, initials).otherwise(F.concat_ws(" ", initials, F.substr(longest, F.lit(1), F.lit(5))))


def append_noise(text: Column, key: Column, step: str = "noise") -> Column:
    return squeeze(F.concat_ws(" ", text, one_of(NOISE_SUFFIXES, key, step)))


def digits(key: Column, least: int, most: int, salt: str) -> Column:
    """A number of least to most digits, most at most 28."""
    ten = F.concat(*(F.lpad((choice(key, 10**7, f"{salt}-{k}")).cast("string"), 7, "0") for k in range(-(-most // 7))))
    return F.substr(ten, F.lit(1), least + choice(key, most - least + 1, f"{salt}-size"))


def add_noise(text: Column, key: Column, step: str = "noise") -> Column:
    """Words of a transfer, with a reference with probability .3, before the text with probability .2, else after it."""
    word = one_of(NOISE, key, step)
    word = F.when(choice(key, 10, f"{step}-ref") < 3, F.concat_ws(" REF ", word, digits(key, 6, 10, f"{step}-number"))).otherwise(word)
    return F.when(choice(key, 10, f"{step}-front") < 2, F.concat_ws(" ", word, text)).otherwise(F.concat_ws(" ", text, word))


OPERATIONS: dict[str, Callable[[Column, Column, str], Column]] = {
    "REMOVE_LEGAL": remove_legal, "DROP_TOKEN": drop_token, "TRUNCATE": truncate_tokens, "DELETE_CHAR": delete_characters, "TRANSPOSE_CHAR": transpose_characters, "SUBSTITUTE_CHAR": confuse,
    "DROP_VOWELS": drop_vowels, "MERGE_TOKENS": merge_tokens, "REMOVE_SPACES": join_tokens, "SHUFFLE_TOKENS": shuffle_tokens, "INITIALISM": initialism, "ADD_NOISE": add_noise,
}

# The pipelines of hard positives.
PIPELINES: dict[str, tuple[str, ...]] = {
    "LEGAL_DROP_TOKEN_DROP_TYPO": ("REMOVE_LEGAL", "DROP_TOKEN", "DELETE_CHAR", "ADD_NOISE"),
    "TOKEN_TRUNCATION_TYPO": ("REMOVE_LEGAL", "TRUNCATE", "SUBSTITUTE_CHAR", "ADD_NOISE"),
    "NO_SPACE_CHARACTER_ERRORS": ("REMOVE_LEGAL", "REMOVE_SPACES", "DELETE_CHAR", "TRANSPOSE_CHAR", "ADD_NOISE"),
    "TOKEN_SHUFFLE_TRUNCATION": ("REMOVE_LEGAL", "SHUFFLE_TOKENS", "TRUNCATE", "ADD_NOISE"),
    "VOWEL_DROP_TOKEN_DROP": ("REMOVE_LEGAL", "DROP_VOWELS", "DROP_TOKEN", "ADD_NOISE"),
    "MERGED_TOKEN_TYPO": ("REMOVE_LEGAL", "MERGE_TOKENS", "DELETE_CHAR", "ADD_NOISE"),
    "INITIALISM_WITH_HINT": ("REMOVE_LEGAL", "INITIALISM", "ADD_NOISE"),
    "MULTI_TYPO": ("REMOVE_LEGAL", "DELETE_CHAR", "SUBSTITUTE_CHAR", "TRANSPOSE_CHAR", "ADD_NOISE"),
}


def mutate(df: DataFrame, text: str, key: str, pipeline: str, name: str = "query_text") -> DataFrame:
    """Adds the text after the operations of the pipeline that the column ``pipeline`` names, white space squeezed after each.

    A text that becomes empty stays so. Each step is a column of its own; a row runs only its own operation.
    """
    out = df.withColumn(name, squeeze(F.col(text)))
    for i in range(max(map(len, PIPELINES.values()))):
        steps: dict[str, list[str]] = {}
        for p, operations in PIPELINES.items():
            if i < len(operations):
                steps.setdefault(operations[i], []).append(p)
        now, new = F.col("_now"), F.col("_now")
        for operation, names in steps.items():
            new = F.when(F.col(pipeline).isin(names), squeeze(OPERATIONS[operation](now, F.col(key), f"{i}-{operation}"))).otherwise(new)
        out = fixed(out.withColumnRenamed(name, "_now"), F.when(F.col("_now") == "", F.col("_now")).otherwise(new), name).drop("_now")
    return out


EASY, MEDIUM, HARD = "EASY", "MEDIUM", "HARD"


def variants(df: DataFrame, text: str = "source_alias", key: str = "key", difficulty: str = "difficulty") -> DataFrame:
    """Adds query_text and corruption_type: noise alone, one corruption and noise, or two for names in Latin letters and noise.

    Of the second corruption of a hard one, what leaves fewer than five letters or digits is taken back.
    """
    k, t, d = F.col(key), F.col(text), F.col(difficulty)
    light = (("delete_character", delete_character), ("swap_adjacent_characters", swap_characters), ("remove_vowels", remove_vowel))
    c = df.withColumns({"_latin": latin_dominant(t), "_words": F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")), "_first": choice(k, 3, "first"), "_two": choice(k, 2, "two"), "_second": choice(k, 3, "second")})
    hard = d == HARD
    name = F.when(d == EASY, "banking_noise")
    name = name.when((d == MEDIUM), F.element_at(F.array(*(F.lit(n) for n, _ in light)), F.col("_first") + 1))
    name = name.when(~F.col("_latin"), F.element_at(F.array(F.lit("non_latin_delete_character"), F.lit("non_latin_swap_adjacent_characters")), F.col("_two") + 1))
    name = name.when(F.col("_words") >= 2, F.element_at(F.array(F.lit("abbreviate_tokens"), F.lit("remove_spaces")), F.col("_two") + 1)).otherwise("remove_vowels")
    c = c.withColumn("corruption_type", name)
    first, n = t, F.col("corruption_type")
    for label, f in (*light, ("abbreviate_tokens", abbreviate), ("remove_spaces", remove_spaces)):
        first = F.when(n.isin(label, f"non_latin_{label}"), squeeze(f(t, k, f"1-{label}"))).otherwise(first)
    c = c.withColumn("_one", first)
    one, second = F.col("_one"), F.col("_one")
    for i, (label, f) in enumerate(light):
        second = F.when(F.col("_second") == i, squeeze(f(one, k, f"2-{label}"))).otherwise(second)
    c = c.withColumn("_both", F.when(hard & F.col("_latin"), second))
    enough = F.coalesce(F.length(F.regexp_replace("_both", r"[^\p{L}\p{N}]", "")) >= 5, F.lit(False))
    c = c.withColumn("corruption_type", F.when(enough, F.concat_ws("+", n, F.element_at(F.array(*(F.lit(x) for x, _ in light)), F.col("_second") + 1))).otherwise(n))
    c = fixed(c, append_noise(F.when(enough, F.col("_both")).otherwise(one), k, "noise"), "query_text")
    return c.drop("_latin", "_words", "_first", "_two", "_second", "_one", "_both")


def ambiguous(query: Column) -> Column:
    """Empty, under five characters without spaces, or a single word of at most four."""
    bare = F.regexp_replace(query, r"\s", "")
    return (bare == "") | (F.length(bare) < 5) | ((F.size(F.split(F.trim(query), r"\s+")) == 1) & (F.length(F.trim(query)) <= 4))
