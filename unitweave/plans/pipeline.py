"""The whole pipeline over tables, and its stages one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitweave.functions import providers as P
from unitweave.functions import text as T
from unitweave.operators import canonical, entities, extract, hierarchy, release
from unitweave.plans.config import Config
from unitweave.sources.stages import stage_table


class Pipeline:
    """Tables in, tables out; providers stand for models and may be exchanged."""

    def __init__(self, config: Config = Config(), language=None, spans=None, entity_tagger=None, embedder=None):
        self.config = config
        self.language = language or P.RuleLanguageTagger()
        self.spans = spans or P.RuleSpanTagger()
        self.entity_tagger = entity_tagger or P.RuleEntityTagger()
        self.embedder = embedder or P.HashEmbedder()

    def extract(self, affiliations: DataFrame, links: DataFrame, strings: DataFrame, institutions: DataFrame) -> dict[str, DataFrame]:
        return {
            "counted_strings": extract.raw_string_counts(affiliations, links, strings),
            "institution_lists": extract.institution_lists(affiliations, links),
            "institution_names": extract.institution_names(institutions),
            "education": extract.education_institutions(institutions),
        }

    def detect_language(self, strings: DataFrame) -> DataFrame:
        return self.language.tag(strings)

    def tag_entities(self, strings: DataFrame) -> DataFrame:
        """Strings in the wanted language with the entities of their best spans, in span order; span_pos tells each one's span.

        Of a span the first max_tokens words are tagged, as a model with bounded input does.
        """
        key = "raw_affiliation_string_id"
        rows = entities.require_columns(strings, (key, "institution_count", "frequency", "raw_affiliation_string"))
        rows = entities.keep_language(entities.first_rows(rows, self.config.max_rows, key), self.config.keep_language)
        rows = rows.select(key, "institution_count", "frequency", T.clean_affiliation(F.col("raw_affiliation_string")).alias("text"))
        chosen = self.spans.spans(rows).select(key, "institution_count", "frequency", F.posexplode(entities.choose_spans(F.col("spans"), F.col("institution_count"))).alias("span", "text"))
        chosen = chosen.withColumn("text", T.first_words(F.col("text"), self.config.max_tokens))
        tagged = self.entity_tagger.entities(chosen).withColumn("entities", entities.keep_groups(entities.merge_touching(F.col("entities"))))
        grouped = tagged.groupBy(key, "institution_count", "frequency").agg(F.array_sort(F.collect_list(F.struct("span", "entities"))).alias("s"))
        return grouped.select(key, "institution_count", "frequency", *self._flat()).where(F.size("entities") > 0)

    @staticmethod
    def _flat() -> list[Column]:
        place = F.transform("s", lambda x: F.transform(x["entities"], lambda e: x["span"]))
        return [F.flatten(F.transform("s", lambda x: x["entities"])).alias("entities"), F.flatten(place).alias("span_pos")]

    def attribute(self, ner: DataFrame, lists: DataFrame, institutions: DataFrame, abbreviations: DataFrame) -> DataFrame:
        return entities.attribute(ner, lists, institutions, abbreviations, self.config)

    def canonicalise(self, names: DataFrame, detailed: bool = False) -> tuple[DataFrame, DataFrame]:
        """Cluster rows of names (institution_id, clean_dept_str, frequency), and borderline pairs for review."""
        c = self.config
        rows = canonical.check_names(stage_table(canonical.load_names(names, c), "loaded"), c)
        for stage in (canonical.strip_person_prefixes, canonical.unify_suffix_variants, canonical.unify_core_variants):
            rows = stage(rows, c)
        rows = stage_table(rows, "names")
        found = canonical.records(rows)
        vectors = found.join(self.embedder.embed(found), "name")
        vectors = stage_table(vectors, "vectors")
        labels = canonical.cluster_records(vectors, c.distance_threshold, c.linkage)
        labels = stage_table(labels, "labels")
        clustered = found.join(labels, ["institution_id", "name"])
        return canonical.cluster_rows(clustered, canonical.members(rows), detailed), canonical.borderline_pairs(vectors, labels, c.distance_threshold, c.borderline_margin)

    def run(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """All stages over tables: work_affiliation, work_affiliation_institution, raw_affiliation_string, institution, abbreviations.

        Raises where an institution's id occurs twice, no name is left, a unit gets two parents or a released id leads
        nowhere. match_ratio is the share of attributed rows that get a canonical name.
        """
        release.check_unique(tables["institution"], ["institution_id"], "institution")
        got = self.extract(tables["work_affiliation"], tables["work_affiliation_institution"], tables["raw_affiliation_string"], tables["institution"])
        ner = stage_table(self.tag_entities(self.detect_language(got["counted_strings"])), "entities")
        detailed = stage_table(self.attribute(ner, got["institution_lists"], got["institution_names"], tables["abbreviations"]), "attributed")
        clusters, borderline = self.canonicalise(entities.dedupe_input(detailed))
        clusters = stage_table(clusters, "clusters")
        rows = stage_table(canonical.attach_canonical(detailed, clusters), "canonical")
        tree = hierarchy.check_one_parent(stage_table(hierarchy.build(rows, got["institution_names"], self.config), "tree"))
        out = release.release(rows, tree, got["institution_names"], got["education"], tables["raw_affiliation_string"])
        out = release.check_release({name: stage_table(table, name) for name, table in out.items()})
        return {**got, "entities": ner, "attributed": detailed, "clusters": clusters, "borderline": borderline, "canonical": rows, "match_ratio": canonical.match_ratio(detailed, rows), "tree": tree, **out}
