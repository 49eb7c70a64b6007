"""Declared schemas of machine-written records; nothing is inferred."""

from __future__ import annotations

EVAL_SETTING = (
    "struct<benchmark:string,metric:string,metric_meaning:string,higher_is_better:boolean,unit:string,method_value:string,"
    "baseline_name:string,baseline_value:string,table_label:string,source_quote:string>"
)
INSIGHT = "struct<finding:string,why_it_matters:string>"
SETUP = "struct<datasets:string,training_config:string,hardware:string,compute:string>"
NOTES = (
    f"struct<problem:string,method:string,result:string,limitation:string,method_name:string,intuition:string,"
    f"insights:array<{INSIGHT}>,eval_settings:array<{EVAL_SETTING}>,setup:{SETUP}>"
)
GOLD = "survey_id string, query string, date string, gold array<string>"
ATOM_ENTRY = (
    "id string, title string, summary string, published string, author array<struct<name:string>>, "
    "category array<struct<_term:string>>"
)
THREAD = (
    "version int, threadId string, title string, createdAt string, updatedAt string, "
    "messages array<struct<id:string,role:string,content:string,runId:string,createdAt:string>>, "
    "artifacts array<struct<id:string,kind:string,title:string,reportId:string>>, "
    "runs array<struct<runId:string,status:string,currentNode:string,error:string,startedAt:string,updatedAt:string,"
    "finishedAt:string,answer:string>>, _corrupt string"
)
RUN_META = (
    "status string, total_seconds double, node_wall_seconds map<string,double>, "
    "llm_calls array<struct<node:string,seconds:double>>, "
    "artifacts struct<pmrl_by_paper:map<string,string>,report_markdown:string>"
)
RUN_STATE = (
    "status string, final_report string, selected_papers array<struct<paper_id:string,arxiv_id:string,"
    "notes:struct<problem:string,method:string,result:string,limitation:string>>>"
)
NOTE_FILE = "problem string, method string, result string, limitation string"
SUMMARY = (
    "struct<kind:string,lead:string,paper:string,papers:array<string>,actions:map<string,string>,"
    "blocks:array<struct<type:string,rows:array<map<string,string>>,items:array<string>>>>"
)
