"""Texts stay where they are read."""

import re

import pytest
from codelode.plans.catalogue import QUERIES

FOLDER = "/root/testdata/sf0.001"
OVER_TEXTS = """file_inventory content_hash_dups file_lines comment_strip_savings cache_hits large_files rule_hits sql_text_scan code_table_scan staleness checklist_summary checklist_ids doc_sections
ai_context_tokens health_score style_findings context_ignore import_span largest_files code_functions code_dead code_components
minify_savings strip_docs context_entries""".split()


@pytest.mark.parametrize("name", OVER_TEXTS)
def test_no_text_is_shuffled(spark, name, capsys):
    df = QUERIES[name](spark, FOLDER)
    capsys.readouterr()
    df.explain("formatted")
    plan = capsys.readouterr().out
    moved = re.findall(r"\(\d+\) (?:Broadcast)?Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert moved or "Exchange" not in plan
    assert not [x for x in moved if re.search(r"\b(?:raw|text|line)#", x)], moved
