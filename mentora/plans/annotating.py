"""Annotation by calls over the driver's dialogues and trees, with a rule in place of a language model and its SQL."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentora.operators import calls, tagging
from mentora.operators import turns as U
from mentora.plans.sql import SQL
from mentora.sources import adapters as A
from mentora.sources.files import dictionary_file, new_path, read_ids, stored

ANNOTATING: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ANNOTATING_SQL: dict[str, str] = {}
#: The rule's reply can't be read if the dialogue's length leaves so much modulo 7.
FAILS = {"domain": 1, "cluster": 2, "standard": 3, "correctness": 4, "kcs": 5}
NO_REPLY = "I can not say."
#: Groups of domains to choose from: place, name and categories.
GROUPS = ((0, "G0", ("G0",)), (1, "G1", ("G1", "AFRICA")), (2, "G2", ("ASIA", "EUROPE")))


def annotating(sql: str | None):
    def add(f):
        ANNOTATING[f.__name__] = f
        if sql is not None:
            ANNOTATING_SQL[f.__name__] = sql
        return f

    return add


def rule(prompt: str, step: str) -> str:
    """A model's reply by rule: options and labels by the dialogue's length, no JSON where FAILS says so."""
    n = len(prompt[: prompt.index("[END DIALOGUE]") + len("[END DIALOGUE]")])
    if n % 7 == FAILS[step]:
        return NO_REPLY
    turns = range(1, int(m.group(1)) + 1) if (m := re.search(r"exactly ([0-9]+) turn", prompt)) else ()
    if step == "correctness":
        result = {f"turn {i}": ("true", "false", "na")[(n + i) % 3] for i in turns}
    elif step == "kcs":
        result = {f"turn {i}": [f"skill {(n + i) % 5}", f"skill {n % 3 + 5}"][: (n + i) % 3] for i in turns}
    else:
        options = re.search(r"\[BEGIN [A-Z/ ]+\]\n- (.*)\n\[END [A-Z/ ]+\]", prompt, re.DOTALL).group(1).split("\n- ")
        pick = lambda k: options[k % len(options)].split(": ", 1)[1].split(", Description: ", 1)[0]
        result = {f"turn {i}": [pick(n + i)] * ((n + i) % 4 > 0) for i in turns} if step == "standard" else list(dict.fromkeys([pick(n), pick(n // 3)]))
    return "So I choose:\n```json" + json.dumps({"result": result}) + "```"


def rule_calls(spark: SparkSession) -> tagging.Ask:
    """The rule behind one cache table, as a model would be asked."""
    return calls.CachedAsk(lambda prompt, system: rule(prompt, system), new_path(spark, "reply-cache"), "rule")


def _dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = U.coalesce_turns(A.utterances(spark, sf_dir))
    numbers = turns.groupBy("d").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return stored(U.dialogue_texts(turns).join(numbers, "d"), "dialogues")


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Groups of domains, and regions, nations and suppliers as domains, clusters and standards."""
    region, nation, supplier = (A.table(spark, sf_dir, x) for x in ("region", "nation", "supplier"))
    top = F.concat(F.lit("K."), F.col("r_name"))
    middle = F.concat(top, F.lit("."), F.col("n_nationkey").cast("string"))
    nations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    row = lambda df, i, text, level, parent: df.select(i.alias("id"), text.alias("description"), F.lit(level).alias("level"), parent.alias("parent"))
    tree = row(region, top, F.col("r_name"), "Domain", F.concat(F.lit("G"), (F.col("r_regionkey") % 2).cast("string")))
    tree = tree.unionByName(row(nations, middle, F.col("n_name"), "Cluster", top)).unionByName(row(suppliers, F.concat(middle, F.lit("."), F.col("s_suppkey").cast("string")), F.col("s_name"), "Standard", middle))
    groups = spark.createDataFrame([(i, name, f"group {i}", list(x)) for i, name, x in GROUPS], "place int, name string, description string, categories array<string>")
    return groups, tree


def _shown(annotated: DataFrame) -> DataFrame:
    """One row a dialogue with the annotation as text, turn by turn."""
    number = lambda k: F.regexp_extract(k, "([0-9]+)", 1).cast("int")
    label = lambda c: F.when(c.isNull(), "na").when(c, "true").otherwise("false")
    entries = F.array_sort(F.transform(F.map_entries("annotation"), lambda e: F.struct(number(e["key"]).alias("turn"), F.concat_ws("|", number(e["key"]).cast("string"), label(e["value"]["correct"]), F.array_join(e["value"]["kcs"], "+")).alias("text"))))
    return annotated.select("d", "error", F.array_join(F.transform(entries, lambda e: e["text"]), ";").alias("annotation"), *[c for c in ("domains", "clusters") if c in annotated.columns])


_TEXTS = f"""c0 AS (SELECT * FROM ({SQL['turns_coalesced']})),
x0 AS MATERIALIZED (SELECT d, max(turn) AS last_turn, len('[BEGIN DIALOGUE]' || chr(10) || coalesce(string_agg(nullif(concat_ws(chr(10), CASE WHEN teacher <> '' THEN 'Teacher Turn ' || turn || ': ' || teacher END, CASE WHEN student <> '' THEN 'Student Turn ' || turn || ': ' || student END), ''), chr(10) ORDER BY turn), '') || chr(10) || '[END DIALOGUE]') AS n, list(turn ORDER BY turn) AS turns FROM c0 GROUP BY d)"""
_LABEL = "CASE (n + i) % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'na' END"
_ERROR = "CASE WHEN {kcs} OR n % 7 = 4 THEN 'JSON parsing error' WHEN len(turns) <> last_turn + CASE WHEN turns[1] = 0 THEN 1 ELSE 0 END THEN 'Different number of annotations and source turns' END"


@annotating(f"""WITH {_TEXTS},
s AS (SELECT 'K.' || r_name AS id, r_name AS description, 'Domain' AS level, 'G' || r_regionkey % 2 AS parent FROM region
  UNION ALL SELECT 'K.' || r_name || '.' || n_nationkey, n_name, 'Cluster', 'K.' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'K.' || r_name || '.' || n_nationkey || '.' || s_suppkey, s_name, 'Standard', 'K.' || r_name || '.' || n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
g(place, name, cats) AS (VALUES {', '.join(f"({i}, '{name}', [{', '.join(repr(c) for c in x)}])" for i, name, x in GROUPS)}),
dom AS (SELECT d, n, list_distinct([n % 3, (n // 3) % 3]) AS picks FROM x0 WHERE n % 7 <> 1),
cat AS (SELECT DISTINCT d, unnest(cats) AS cat FROM dom JOIN g ON list_contains(picks, place)),
top AS (SELECT DISTINCT d, id FROM cat JOIN s ON level = 'Domain' AND (ends_with(id, '.' || cat) OR parent = cat)),
co AS (SELECT d, list(s.id ORDER BY 'ID: ' || s.id || ', Description: ' || s.description) AS o FROM top JOIN s ON s.parent = top.id GROUP BY d),
cl AS (SELECT d, n, list_distinct([o[n % len(o) + 1], o[(n // 3) % len(o) + 1]]) AS picks FROM x0 JOIN co USING (d) WHERE n % 7 <> 2),
so AS (SELECT d, list(s.id ORDER BY 'ID: ' || s.id || ', Description: ' || s.description) AS o FROM cl JOIN s ON list_contains(cl.picks, s.parent) GROUP BY d),
st AS (SELECT d, true AS found, o FROM x0 JOIN so USING (d) WHERE n % 7 <> 3),
e AS (SELECT x0.d, {_ERROR.format(kcs='found IS NULL')} AS error FROM x0 LEFT JOIN st ON st.d = x0.d),
tu AS (SELECT x0.d, x0.n, i, {_LABEL.replace('n +', 'x0.n +')} AS label, CASE WHEN (x0.n + i) % 4 > 0 THEN o[(x0.n + i) % len(o) + 1] END AS id FROM x0 JOIN st ON st.d = x0.d, range(1, 1000) AS t(i) WHERE i <= last_turn),
an AS (SELECT d, string_agg(i || '|' || label || '|' || coalesce(description, ''), ';' ORDER BY i) AS annotation FROM tu LEFT JOIN s ON s.id = tu.id GROUP BY d)
SELECT e.d, error, CASE WHEN error IS NULL THEN coalesce(annotation, '') END AS annotation, CASE WHEN dom.d IS NOT NULL THEN len(dom.picks) END AS domains, CASE WHEN cl.d IS NOT NULL THEN len(cl.picks) END AS clusters
FROM e LEFT JOIN an ON an.d = e.d LEFT JOIN dom ON dom.d = e.d LEFT JOIN cl ON cl.d = e.d""")
def hierarchical_annotation(spark, sf_dir):
    """Domains, clusters, standards and correctness of all dialogues; replies fail at each level for some."""
    groups, tree = _tree(spark, sf_dir)
    out = tagging.annotate(_dialogues(spark, sf_dir), "atc", rule_calls(spark), groups, tree)
    sizes = {f"{x}s": F.when(F.col(x).isNotNull(), F.size(x)).cast("long") for x in ("domain", "cluster")}
    return _shown(out.withColumns(sizes))


@annotating(f"""WITH {_TEXTS}, e AS (SELECT d, {_ERROR.format(kcs='n % 7 = 5')} AS error FROM x0),
tu AS (SELECT d, n, i, {_LABEL} AS label, CASE (n + i) % 3 WHEN 0 THEN '' WHEN 1 THEN 'skill ' || (n + i) % 5 ELSE 'skill ' || (n + i) % 5 || '+skill ' || (n % 3 + 5) END AS kcs FROM x0, range(1, 1000) AS t(i) WHERE i <= last_turn),
an AS (SELECT d, string_agg(i || '|' || label || '|' || kcs, ';' ORDER BY i) AS annotation FROM tu GROUP BY d)
SELECT e.d, error, CASE WHEN error IS NULL THEN coalesce(annotation, '') END AS annotation FROM e LEFT JOIN an ON an.d = e.d""")
def base_annotation(spark, sf_dir):
    """Skills in the model's own words and correctness of all dialogues."""
    return _shown(tagging.annotate(_dialogues(spark, sf_dir), "base", rule_calls(spark)))


def _flaky(prompt: str, _: str | None) -> str:
    """An answer for each prompt but those whose length is a multiple of 5."""
    if len(prompt) % 5 == 0:
        raise TimeoutError("no answer in time")
    return prompt.upper()


@annotating("""WITH p AS (SELECT text, length(text) % 5 = 0 AS bad FROM conversations WHERE role = 'user' AND text IS NOT NULL), u AS (SELECT DISTINCT text, bad FROM p)
SELECT (SELECT count(*) FROM p) AS rows, count(*) AS asked, count(*) FILTER (NOT bad) AS answered, count(*) FILTER (bad) AS asked_again, count(*) FILTER (bad) AS answered_again, 0 AS asked_at_last, (SELECT count(*) FROM p) AS with_response FROM u""")
def cached_calls_rerun(spark, sf_dir):
    """Prompts asked of a model that fails on some, then of one that doesn't, then once more: what each run sent."""
    prompts = A.table(spark, sf_dir, "conversations").where("role = 'user' and text is not null").select(F.col("text").alias("prompt"))
    cache = new_path(spark, "reply-cache")
    ask = lambda provider: calls.cached_calls(prompts, provider, cache, "m", wave=500, strict=False)
    first, again, last = ask(_flaky), ask(lambda prompt, _: prompt.upper()), ask(_flaky)
    counted = last.rows.agg(F.count("*").alias("rows"), F.count(F.when(F.col("response").isNotNull(), 1)).alias("with_response"))
    return counted.select("rows", *[F.lit(v).cast("long").alias(k) for k, v in (("asked", first.asked), ("answered", first.answered), ("asked_again", again.asked), ("answered_again", again.answered), ("asked_at_last", last.asked))], "with_response")


@annotating(f"""WITH {_TEXTS}, e AS (SELECT d, n, last_turn, {_ERROR.format(kcs='n % 7 = 5')} AS error FROM x0),
k AS (SELECT d, i, unnest(CASE (n + i) % 3 WHEN 0 THEN [] WHEN 1 THEN ['skill ' || (n + i) % 5] ELSE ['skill ' || (n + i) % 5, 'skill ' || (n % 3 + 5)] END) AS name, unnest(range((n + i) % 3)) AS pos FROM e, range(1, 1000) AS t(i) WHERE i <= last_turn AND error IS NULL),
f AS (SELECT name, min(struct_pack(d := d, i := i, pos := pos)) AS first FROM k GROUP BY name) SELECT name, CAST(row_number() OVER (ORDER BY first) - 1 AS INT) AS id FROM f""")
def annotation_dictionary(spark, sf_dir):
    """Skills of the base annotation in order of first appearance, written as a dictionary file and read back."""
    folder = new_path(spark, "annotated")
    tagging.save_annotations(tagging.annotate(_dialogues(spark, sf_dir), "base", rule_calls(spark)), "conversations", "base", folder=folder)
    return read_ids(spark, dictionary_file("conversations", "base", folder))
