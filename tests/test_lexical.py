"""Cover density against all covers by brute force, stems against published pairs, stemmed search against a plain version."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quern.functions.stems import stemmed
from quern.operators import lexical
from quern.session import cut

PAIRS = {
    "en": "consign:consign consigned:consign consigning:consign consignment:consign consistency:consist consistently:consist consolation:consol consolatory:consolatori consoled:consol "
    "knackeries:knackeri knaves:knave kneeling:kneel knightly:knight hopping:hop hoped:hope happy:happi cries:cri ties:tie skies:sky news:news proceed:proceed relational:relat national:nation "
    "generously:generous flies:fli dying:die sensational:sensat agreed:agre gas:gas this:this kiwis:kiwi say:say cry:cri enjoy:enjoy",
    "german": "aufeinander:aufeinand aufeinanderfolge:aufeinanderfolg aufeinanderfolgenden:aufeinanderfolg kategorie:kategori kategorisch:kategor kater:kat häuser:haus freundlichkeit:freundlich verhältnisse:verhaltnis groß:gross",
    "french": "continu:continu continua:continu continuait:continu continuation:continu continuellement:continuel mains:main maintenir:mainten majestueuse:majestu malade:malad maladie:malad majesté:majest",
    "es": "chicharrones:chicharron chicos:chic torear:tor torneado:torn trabajando:trabaj trabajador:trabaj naciones:nacion rápidamente:rapid",
    "tr": "anahtarını:anahtarını",
}


def test_published_stems(spark):
    want = sorted((c, *p.split(":")) for c, ps in PAIRS.items() for p in ps.split()) + [(None, "running", "running")]
    rows = [(c, t, "kept") for c, t, _ in want] + [("en", None, "kept")]
    got = stemmed(spark.createDataFrame(rows, "config string, term string, w string"))
    assert got.columns == ["config", "term", "w", "stem"]
    rows = got.collect()
    assert sorted(((r.config, r.term, r.stem) for r in rows if r.term is not None), key=str) == sorted(want, key=str)
    assert [r.stem for r in rows if r.term is None] == [None]


def test_a_dictionary_is_stemmed_anew_only_where_it_must(spark):
    old = spark.createDataFrame([("en", "running", "kept as it was"), ("en", "gone", "gone")], "config string, term string, stem string")
    words = spark.createDataFrame([("en", "running"), ("de", "häuser")], "config string, term string")
    assert sorted(tuple(r) for r in lexical.restem(old, words).collect()) == [("de", "häuser", "haus"), ("en", "running", "kept as it was")]


def all_covers(at, n):
    """The smallest stretches that hold n terms: every stretch is tried."""
    holds = [(i, j) for i in range(len(at)) for j in range(i, len(at)) if len({t for _, t in at[i : j + 1]}) == n]
    small = [(i, j) for i, j in holds if not any((a, b) != (i, j) and i <= a and b <= j for a, b in holds)]
    return sum(0.1 / (1 + at[j][0] - at[i][0] - (j - i)) for i, j in small)


def test_cover_density_against_all_covers(spark):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        n = rng.randrange(1, 5)
        at = sorted({p: rng.randrange(n) for p in rng.sample(range(1, 40), rng.randrange(1, 14))}.items())
        rows.append((k, n, at))
    df = spark.createDataFrame(rows, "k int, n long, at array<struct<pos:int,no:int>>")
    got = {r.k: (r.a, r.o) for r in df.select("k", lexical.covers_all(F.col("at"), F.col("n")).alias("a"), lexical.covers_any(F.col("at")).alias("o")).collect()}
    for k, n, at in rows:
        assert got[k][0] == pytest.approx(all_covers(at, n)) and got[k][1] == pytest.approx(0.1 * len(at))


@pytest.mark.parametrize("stems, every", [(False, False), (True, False), (True, True)])
def test_search_against_a_plain_version(spark, stems, every):
    rng = random.Random(4)
    words = "house houses housing car cars run running runs haus häuser und the of".split()
    chunks = [(c, d, i, [rng.choice(words) for _ in range(rng.randrange(0, 12))]) for c in ("en", "de", "xx", None) for d in range(8) for i in range(3)]
    asked = [(q, c, rng.sample(words, 3)) for q in range(5) for c in ("en", "de", "xx")] + [(9, "en", []), (10, "en", ["absent"])]
    known = {(r.config, r.term): r.stem for r in stemmed(spark.createDataFrame([(c, w) for c in ("en", "de", "xx") for w in [*words, "absent"]], "config string, term string")).collect()}
    name = (lambda c, w: known[c, w]) if stems else (lambda c, w: w)
    want = {}
    for q, c, ts in asked:
        own = [(d, i, t) for cc, d, i, t in chunks if cc == c]
        df = defaultdict(int)
        for _, _, t in own:
            for s in {name(c, w) for w in t}:
                df[s] += 1
        terms = sorted(s for s in {name(c, w) for w in ts} if 0 < df[s] < 15)
        scored = []
        for d, i, t in own:
            at = [(p, terms.index(name(c, w))) for p, w in enumerate(t, 1) if name(c, w) in terms]
            s = (all_covers(at, len(terms)) if every else 0.1 * len(at)) / math.log(len(t) + 1) if at else 0
            if s > 0:
                scored.append((-round(s, 9), len(t), i, d))
        want[q, c] = [(d, i) for _, _, i, d in sorted(scored)][:7]
    df_chunks = spark.createDataFrame(chunks, "config string, doc_id long, chunk_index int, tokens array<string>").repartition(3)
    questions = spark.createDataFrame(asked, "query_id long, config string, tokens array<string>")
    common = spark.createDataFrame([(c, 15) for c in ("en", "de", "xx")], "project string, common_at long")
    got = defaultdict(list)
    rows = lexical.search(df_chunks, questions, cut(common), 7, stems=stems, every=every).collect()
    for r in sorted(rows, key=lambda r: r.lexical_rank):
        got[r.query_id, r.config].append((r.doc_id, r.chunk_index))
    assert dict(got) == {k: v for k, v in want.items() if v}
