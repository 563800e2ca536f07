"""Schemas of all tables the pipeline reads and writes; nothing is inferred."""

from __future__ import annotations

# Work tables of the relational source.
WORK_AFFILIATION = "work_id bigint, affiliation_seq int, raw_affiliation_string_id bigint"
WORK_AFFILIATION_INSTITUTION = "work_id bigint, affiliation_seq int, institution_id bigint"
RAW_STRING = "raw_affiliation_string_id bigint, raw_affiliation_string string"
INSTITUTION = "institution_id bigint, institution_name string, institution_type_id int"
# Tables between the stages.
COUNTED_STRING = "raw_affiliation_string_id bigint, institution_count bigint, frequency bigint, raw_affiliation_string string"
TAGGED_STRING = COUNTED_STRING + ", language string"
ENTITY_ROW = "raw_affiliation_string_id bigint, institution_count bigint, frequency bigint, entities array<struct<entity_group:string,word:string,start:int,end:int>>"
INSTITUTION_LIST = "raw_affiliation_string_id bigint, institution_count bigint, institution_ids_str string"
INSTITUTION_NAME = "institution_id bigint, institution_name string"
ABBREVIATION = "abbr_name string, full_name string"
ATTRIBUTED = "raw_aff_id bigint, institution_ids string, inst_count bigint, raw_dept_str string, clean_dept_str string, start int, end int, frequency bigint"
DEDUPE_INPUT = "institution_ids bigint, clean_dept_str string, frequency string"
CLUSTERS = "institution_id bigint, canonical_dept_name string, cluster_total_frequency bigint, member_dept_name string"
CLUSTERS_DETAILED = "institution_id bigint, canonical_dept_name string, total_frequency bigint, member_count bigint, member_details string"
BORDERLINE = "institution_id bigint, dept_a string, dept_b string, similarity double"
CANONICAL = "raw_affiliation_id bigint, institution_id bigint, raw_dept_str string, clean_dept_str string, start int, end int, frequency bigint, canonical_dept_name string, cluster_total_frequency bigint"
HIERARCHY = "institution_id bigint, institution_name string, parent_name string, child_name string"
EDUCATION = "institution_id bigint"
