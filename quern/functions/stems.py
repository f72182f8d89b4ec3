"""Stems of words in four languages, as column expressions over a table of distinct words.

The rules are the published suffix-stripping ones of the Snowball family (English, German, French, Spanish): regions of a word
(R1, R2, RV) are found by a pattern, and each step takes the longest of its suffixes and drops or replaces it if it lies in
the step's region. Texts are never stemmed word by word: their vocabulary is, once, and joined back (operators/lexical.py).
Words of any other configuration are their own stems. Words are expected in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = {"en": "english", "de": "german", "fr": "french", "es": "spanish"}

# Fixed values of the published rules: vowels, suffixes and what replaces them, words that are exceptions.
_EN_VOWELS, _DE_VOWELS, _FR_VOWELS, _ES_VOWELS = "aeiouy", "aeiouyäöü", "aeiouyâàëéêèïîôûù", "aeiouáéíóúü"
_EN_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_EN_KEPT = "inning|outing|canning|herring|earring|proceed|exceed|succeed"
_EN_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_EN_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_EN_4 = "al|ance|ence|er|ic|able|ible|ant|ement|ment|ent|ism|ate|iti|ous|ive|ize|(?<=[st])ion"
_ES_PRONOUNS = "selas|selos|sela|selo|las|les|los|nos|me|se|la|le|lo"
_ES_1 = "amientos|imientos|amiento|imiento|anzas|ismos|ables|ibles|istas|anza|icos|icas|ismo|able|ible|ista|osos|osas|ico|ica|oso|osa"
_ES_1_IC = "aciones|adoras|adores|ancias|adora|ación|antes|ancia|ador|ante|acion"
_ES_Y = "yeron|yendo|yamos|yais|yan|yen|yas|yes|ya|ye|yo|yó"
_ES_VERBS = (
    "aríamos|eríamos|iríamos|iéramos|iésemos|aríais|eríais|iríais|ierais|ieseis|asteis|isteis|ábamos|áramos|ásemos|arían|arías|aréis|erían|erías|eréis|irían|irías|iréis|ieran|iesen|ieron|iendo|ieras|"
    "ieses|abais|arais|aseis|aremos|eremos|iremos|íamos|arán|arás|aría|erán|erás|ería|irán|irás|iría|iera|iese|aste|iste|aban|aran|asen|aron|ando|abas|adas|idas|aras|ases|íais|ados|idos|amos|imos|ará|aré|erá|"
    "eré|irá|iré|aba|ada|ida|ara|ase|ían|ado|ido|ías|áis|ía|ad|ed|id|an|ió|ar|er|ir|as|ís"
)
_FR_1 = "ances|iqUes|ismes|ables|istes|ance|iqUe|isme|able|iste|eux"
_FR_I_VERBS = "issaIent|issantes|iraIent|issante|issants|issions|irions|issais|issait|issant|issent|issiez|issons|irais|irait|irent|iriez|irons|iront|isses|issez|îmes|îtes|irai|iras|irez|isse|ies|ira|ît|ie|ir|is|it|i"
_FR_VERBS = "eraIent|erions|èrent|erais|erait|eriez|erons|eront|erai|eras|erez|ées|era|iez|ée|és|er|ez|é"
_FR_A_VERBS = "assions|assent|assiez|aIent|antes|asses|âmes|âtes|ante|ants|asse|ais|ait|ant|ât|ai|as|a"


def _has(w: str | Column, pattern: str) -> Column:
    return (F.col(w) if isinstance(w, str) else w).rlike(pattern)


def _after(df: DataFrame, name: str, start: Column, vowels: str) -> DataFrame:
    """Where the region behind the first other letter after a vowel begins, counted from `start`."""
    found = F.length(F.regexp_extract(F.substr("w", start + 1), f"^.*?[{vowels}][^{vowels}]", 0))
    return df.withColumn(name, F.when(found > 0, start + found).otherwise(F.length("w")))


def _regions(df: DataFrame, vowels: str) -> DataFrame:
    return _after(_after(df, "r1", F.lit(0), vowels), "r2", F.col("r1"), vowels)


def _drop(df: DataFrame, suffixes: str | dict, region: str, before: str = "", only: Column | None = None, to: str = "") -> DataFrame:
    """The longest of the suffixes goes (a dict says what replaces it) if it lies in the region and `before` stands before it.
    _s keeps the suffix that was found, _hit whether it went."""
    names = sorted(suffixes, key=len, reverse=True) if isinstance(suffixes, dict) else [suffixes]
    df = df.withColumn("_s", F.regexp_extract("w", f"({'|'.join(names)})$", 1))
    rest = F.substr("w", F.lit(1), F.length("w") - F.length("_s"))
    ok = (F.col("_s") != "") & (F.length("w") - F.length("_s") >= F.col(region))
    if before:
        ok = ok & _has(rest, f"({before})$")
    if only is not None:
        ok = ok & only
    into = F.element_at(F.create_map(*[F.lit(x) for kv in suffixes.items() for x in kv]), F.col("_s")) if isinstance(suffixes, dict) else F.lit(to)
    return df.withColumns({"_hit": ok, "w": F.when(ok, F.concat(rest, into)).otherwise(F.col("w"))})


def _english(df: DataFrame) -> DataFrame:
    v, short = _EN_VOWELS, "(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"
    df = df.withColumn("w", F.regexp_replace(F.regexp_replace("w", "^y", "Y"), f"([{v}])y", "$1Y"))
    df = _regions(df, v)
    head = F.length(F.regexp_extract("w", "^(gener|commun|arsen)", 0))
    df = _after(df.withColumn("r1", F.when(head > 0, head).otherwise(F.col("r1"))), "r2", F.col("r1"), v)
    s = F.when(_has("w", "sses$"), F.regexp_replace("w", "sses$", "ss")).when(_has("w", "(ied|ies)$"), F.regexp_replace("w", "(ied|ies)$", F.when(F.length("w") > 4, "i").otherwise("ie")))
    df = df.withColumn("w", s.when(_has("w", "(us|ss)$"), F.col("w")).when(_has("w", f"[{v}].+s$"), F.regexp_replace("w", "s$", "")).otherwise(F.col("w")))
    df = df.withColumn("_kept", _has("w", f"^({_EN_KEPT})$")).withColumn("_in", F.col("w"))
    eed = _has("w", "(eed|eedly)$")
    df = _drop(df, {"eed": "ee", "eedly": "ee"}, "r1").withColumn("_zero", F.lit(0))
    df = _drop(df, "ingly|edly|ing|ed", "_zero", f"[{v}].*", ~eed)
    mended = F.when(_has("w", "(at|bl|iz)$"), F.concat("w", F.lit("e"))).when(_has("w", "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), F.regexp_replace("w", ".$", ""))
    mended = mended.when((F.col("r1") >= F.length("w")) & _has("w", short), F.concat("w", F.lit("e"))).otherwise(F.col("w"))
    df = df.withColumn("w", F.when(F.col("_hit"), mended).otherwise(F.col("w"))).withColumn("w", F.regexp_replace("w", f"(.[^{v}])[yY]$", "$1i"))
    # the longest suffix of a step decides, whether its own condition holds or not
    step2 = F.regexp_extract("w", f"({'|'.join(sorted([*_EN_2, 'ogi', 'li'], key=len, reverse=True))})$", 1)
    df = df.withColumn("_of", step2)
    df = _drop(df, _EN_2, "r1", only=~F.col("_of").isin("ogi", "li"))
    df = _drop(df, {"ogi": "og"}, "r1", "l", F.col("_of") == "ogi")
    df = _drop(df, "li", "r1", "[cdeghkmnrt]", F.col("_of") == "li")
    df = df.withColumn("_of", F.regexp_extract("w", "(ational|tional|alize|icate|iciti|ative|ical|ness|ful)$", 1))
    df = _drop(df, _EN_3, "r1", only=F.col("_of") != "ative")
    df = _drop(df, "ative", "r2", only=(F.col("_of") == "ative") & (F.length("w") - 5 >= F.col("r1")))
    df = _drop(df, _EN_4, "r2")
    end = F.substr("w", F.lit(1), F.length("w") - 1)
    e = _has("w", "e$") & ((F.length("w") > F.col("r2")) | ((F.length("w") > F.col("r1")) & ~_has(end, short)))
    df = df.withColumn("w", F.when(e | (_has("w", "ll$") & (F.length("w") > F.col("r2"))), end).otherwise(F.col("w")))
    words = F.element_at(F.create_map(*[F.lit(x) for kv in _EN_WORDS.items() for x in kv]), F.col("term"))
    stem = F.when(words.isNotNull(), words).when(F.length("term") < 3, F.col("term")).when(F.col("_kept"), F.col("_in")).otherwise(F.col("w"))
    return df.withColumn("w", F.lower(stem))


def _german(df: DataFrame) -> DataFrame:
    v = _DE_VOWELS
    df = df.withColumn("w", F.regexp_replace(F.regexp_replace(F.regexp_replace("w", "ß", "ss"), f"(?<=[{v}])u(?=[{v}])", "U"), f"(?<=[{v}])y(?=[{v}])", "Y"))
    df = _regions(df, v).withColumn("r1", F.greatest("r1", F.least(F.lit(3), F.length("w"))))
    df = df.withColumn("_of", F.regexp_extract("w", "(ern|em|er|en|es|e|s)$", 1))
    df = _drop(df, "ern|em|er", "r1")
    df = _drop(df, "en|es|e", "r1", only=F.col("_of").isin("en", "es", "e"))
    df = df.withColumn("w", F.when(F.col("_hit") & _has("w", "niss$"), F.regexp_replace("w", "s$", "")).otherwise(F.col("w")))
    df = _drop(df, "s", "r1", "[bdfghklmnrt]", F.col("_of") == "s")
    df = df.withColumn("_of", F.regexp_extract("w", "(est|en|er|st)$", 1))
    df = _drop(df, "est|en|er", "r1", only=F.col("_of") != "st")
    df = _drop(df, "st", "r1", "...[bdfghklmnt]", F.col("_of") == "st")
    df = df.withColumn("_of", F.regexp_extract("w", "(isch|lich|heit|keit|end|ung|ig|ik)$", 1))
    df = _drop(df, "end|ung", "r2", only=F.col("_of").isin("end", "ung"))
    df = _drop(df, "ig", "r2", "[^e]", F.col("_hit"))
    df = _drop(df, "isch|ig|ik", "r2", "[^e]", F.col("_of").isin("isch", "ig", "ik"))
    df = _drop(df, "lich|heit", "r2", only=F.col("_of").isin("lich", "heit"))
    df = _drop(df, "er|en", "r1", only=F.col("_hit"))
    df = _drop(df, "keit", "r2", only=F.col("_of") == "keit")
    df = _drop(df, "lich|ig", "r2", only=F.col("_hit"))
    return df.withColumn("w", F.translate("w", "UYäöü", "uyaou"))


def _french(df: DataFrame) -> DataFrame:
    v = _FR_VOWELS
    marked = F.regexp_replace(F.regexp_replace("w", "qu", "qU"), f"(?<=[{v}])u(?=[{v}])", "U")
    marked = F.regexp_replace(F.regexp_replace(marked, f"(?<=[{v}])i(?=[{v}])", "I"), f"(?<=[{v}])y|y(?=[{v}])", "Y")
    df = _regions(df.withColumn("w", marked), v)
    rv = F.when(_has("w", f"^(par|col|tap)|^[{v}]{{2}}"), F.lit(3)).otherwise(F.length(F.regexp_extract("w", f"^..*?[{v}]", 0)))
    df = df.withColumn("rv", F.when(rv > 0, F.least(rv, F.length("w"))).otherwise(F.length("w"))).withColumn("_w0", F.col("w"))
    df = _drop(df, _FR_1, "r2")
    df = _drop(df, "atrices|ateurs|ations|atrice|ateur|ation", "r2", only=F.col("w") == F.col("_w0"))
    df = df.withColumn("_a", F.col("_hit"))
    df = _drop(df, "ic", "r2", only=F.col("_a"))
    df = df.withColumn("w", F.when(F.col("_a") & ~F.col("_hit"), F.regexp_replace("w", "ic$", "iqU")).otherwise(F.col("w")))
    same = lambda: F.col("w") == F.col("_w0")
    df = _drop(df, {"logie": "log", "logies": "log", "usion": "u", "ution": "u", "usions": "u", "utions": "u", "ence": "ent", "ences": "ent"}, "r2", only=same())
    df = _drop(df, "ements|ement", "rv", only=same()).withColumn("_a", F.col("_hit"))
    df = _drop(df, "ativ|iv|abl|iqU|(?:i|I)èr", "r2", only=F.col("_a"))
    df = _drop(df, "eus", "r2", only=F.col("_a"))
    df = _drop(df, "ités|ité", "r2", only=same()).withColumn("_a", F.col("_hit"))
    df = _drop(df, "abil|ic|iv", "r2", only=F.col("_a"))
    df = _drop(df, "ives|ifs|ive|if", "r2", only=same()).withColumn("_a", F.col("_hit"))
    df = _drop(df, "icat|at", "r2", only=F.col("_a"))
    df = _drop(df, {"eaux": "eau", "aux": "al"}, "r1", only=same())
    df = _drop(df, "euses|euse", "r2", only=same())
    df = _drop(df, {"euse": "eux", "euses": "eux"}, "r1", only=same())
    df = df.withColumn("_one", ~same())
    # endings in -ment leave the verb steps open
    df = _drop(df, {"amment": "ant", "emment": "ent"}, "rv", only=same()).withColumn("_m", F.col("_hit"))
    df = _drop(df, "ments|ment", "rv", f"[{v}]", same()).withColumn("_m", F.col("_m") | F.col("_hit")).withColumn("_w1", F.col("w"))
    verb = ~F.col("_one") | F.col("_m")
    # a verb suffix lies wholly in RV, and those in -i follow another letter there
    df = df.withColumn("_rv1", F.col("rv") + 1)
    df = _drop(df, _FR_I_VERBS, "_rv1", f"[^{v}]", verb).withColumn("_v", F.col("_hit"))
    df = _drop(df, "ions", "r2", only=verb & ~F.col("_v")).withColumn("_v", F.col("_v") | F.col("_hit"))
    df = _drop(df, _FR_VERBS, "rv", only=verb & ~F.col("_v")).withColumn("_v", F.col("_v") | F.col("_hit"))
    df = _drop(df, _FR_A_VERBS, "rv", only=verb & ~F.col("_v")).withColumn("_a", F.col("_hit"))
    df = _drop(df, "e", "rv", only=F.col("_a")).withColumn("_v", F.col("_v") | F.col("_a"))
    changed = F.col("_one") | F.col("_v")
    df = df.withColumn("_c", changed).withColumn("w", F.when(F.col("_c"), F.regexp_replace(F.regexp_replace("w", "Y$", "i"), "ç$", "c")).otherwise(F.col("w")))
    df = df.withColumn("w", F.when(~F.col("_c"), F.regexp_replace("w", "(?<=[^aiouès])s$", "")).otherwise(F.col("w")))
    df = _drop(df, "ion", "r2", "[st]", ~F.col("_c"))
    df = _drop(df, {"ière": "i", "Ière": "i", "ier": "i", "Ier": "i", "e": ""}, "rv", only=~F.col("_c"))
    df = df.withColumn("w", F.regexp_replace("w", "(enn|onn|ett|ell|eill)$", "$1_")).withColumn("w", F.regexp_replace("w", "._$", ""))
    df = df.withColumn("w", F.regexp_replace("w", f"[éè](?=[^{v}]+$)", "e"))
    return df.withColumn("w", F.lower("w"))


def _spanish(df: DataFrame) -> DataFrame:
    v = _ES_VOWELS
    df = _regions(df, v)
    rv = F.when(_has("w", f"^.[^{v}]"), F.length(F.regexp_extract("w", f"^..[^{v}]*[{v}]", 0)))
    rv = rv.when(_has("w", f"^[{v}]{{2}}"), F.length(F.regexp_extract("w", f"^..[{v}]*[^{v}]", 0))).otherwise(F.lit(3))
    df = df.withColumn("rv", F.when(rv > 0, F.least(rv, F.length("w"))).otherwise(F.length("w")))
    df = _drop(df, _ES_PRONOUNS, "rv", "iéndo|ándo|ár|ér|ír|ando|iendo|ar|er|ir|uyendo")
    df = df.withColumn("w", F.when(F.col("_hit") & _has("w", "(iéndo|ándo|ár|ér|ír)$"), F.concat(F.substr("w", F.lit(1), F.length("w") - 5), F.translate(F.substr("w", F.length("w") - 4), "áéí", "aei"))).otherwise(F.col("w")))
    df = df.withColumn("_w0", F.col("w"))
    same = lambda: F.col("w") == F.col("_w0")
    df = _drop(df, _ES_1, "r2")
    df = _drop(df, _ES_1_IC, "r2", only=same()).withColumn("_a", F.col("_hit"))
    df = _drop(df, "ic", "r2", only=F.col("_a"))
    df = _drop(df, {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "ucion": "u", "encia": "ente", "encias": "ente"}, "r2", only=same())
    df = _drop(df, "amente", "r1", only=same()).withColumn("_a", F.col("_hit"))
    df = _drop(df, "ativ|iv|os|ic|ad", "r2", only=F.col("_a"))
    df = _drop(df, "mente", "r2", only=same()).withColumn("_a", F.col("_hit"))
    df = _drop(df, "ante|able|ible", "r2", only=F.col("_a"))
    df = _drop(df, "idades|idad", "r2", only=same()).withColumn("_a", F.col("_hit"))
    df = _drop(df, "abil|ic|iv", "r2", only=F.col("_a"))
    df = _drop(df, "ivas|ivos|iva|ivo", "r2", only=same()).withColumn("_a", F.col("_hit"))
    df = _drop(df, "at", "r2", only=F.col("_a"))
    df = df.withColumn("_one", ~same())
    df = _drop(df, _ES_Y, "rv", "u", ~F.col("_one")).withColumn("_one", F.col("_one") | F.col("_hit"))
    df = df.withColumn("_of", F.regexp_extract("w", f"({_ES_VERBS}|emos|éis|en|es)$", 1))
    df = _drop(df, "emos|éis|en|es", "rv", only=~F.col("_one") & F.col("_of").isin("emos", "éis", "en", "es")).withColumn("_a", F.col("_hit"))
    df = df.withColumn("w", F.when(F.col("_a"), F.regexp_replace("w", "(?<=g)u$", "")).otherwise(F.col("w")))
    df = _drop(df, _ES_VERBS, "rv", only=~F.col("_one") & ~F.col("_a") & ~F.col("_of").isin("emos", "éis", "en", "es"))
    df = _drop(df, "os|a|o|á|í|ó", "rv").withColumn("_a", F.col("_hit"))
    df = _drop(df, "e|é", "rv", only=~F.col("_a"))
    df = df.withColumn("w", F.when(F.col("_hit") & _has("w", "gu$") & (F.length("w") > F.col("rv")), F.regexp_replace("w", "u$", "")).otherwise(F.col("w")))
    return df.withColumn("w", F.translate("w", "áéíóú", "aeiou"))


_RULES = {"english": _english, "german": _german, "french": _french, "spanish": _spanish}


def stemmed(words: DataFrame, config: str = "config", term: str = "term") -> DataFrame:
    """words (distinct pairs of configuration and word) plus stem. Configurations are names or codes of LANGUAGES; words of any
    other, null too, stay as they are. A null word has a null stem. Empty table: empty result.

    Write the result (session.cut) before it is filtered or joined by stem: the rules are a long chain of steps, and a
    predicate on the stem would be copied through all of them."""
    kept = words.columns
    plain = words.withColumn("_config", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.col(config)), F.col(config)))
    out = plain.filter(F.col("_config").isNull() | ~F.col("_config").isin(*_RULES)).select(*kept, F.col(term).alias("stem"))
    for name, rule in _RULES.items():
        own = plain.filter(F.col("_config") == name).select(F.struct(*kept).alias("_row"), F.col(term).alias("term"), F.col(term).alias("w"))
        out = out.unionByName(rule(own).select("_row.*", F.col("w").alias("stem")))
    return out
