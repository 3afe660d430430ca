"""Schemas of the working tables."""

from __future__ import annotations

SPAN = ("struct<field:string,type:string,value:string,start:int,`end`:int,"
        "confidence:double,method:string>")

ELEMENT = (
    "struct<id:string,tag:string,selector:string,text:string,placeholder:string,"
    "value:string,href:string,type:string,autocomplete:string,role:string,"
    "interactive:boolean,coordinates:array<double>,rect:array<double>,"
    "parentTag:string,parentClass:string,parentId:string,nearbyLabels:string>"
)
FORM = ("struct<id:string,action:string,method:string,inputs:array<string>,"
        "vault_available:map<string,boolean>>")
SNAPSHOT = (
    "session_id string, step_no bigint, url string, title string, elements_count int, "
    f"elements array<{ELEMENT}>, forms array<{FORM}>, "
    "viewport struct<width:int,height:int,scroll_x:int,scroll_y:int>, "
    "context_sufficient boolean"
)
MESSAGE = "type string, session_id string, client_timestamp double, payload string"
TARGET = ("struct<selector:string,url:string,coordinates:array<double>,text:string,"
          "tab_id:int,tab_purpose:string>")
PLAN_STEP = (
    f"struct<id:int,step_id:int,action_id:int,action:string,target:{TARGET},"
    "selector:string,url:string,coordinates:array<double>,text:string,tab_id:int,"
    "tab_purpose:string,value:string,`key`:string,vault_key:string,"
    "execution_mode:string,protocol_level:string,risk_level:string,riskLevel:string,"
    "description:string,verify:struct<method:string,condition:string>,"
    "fallback:struct<action:string,reason:string>,timeout_ms:int,duration_ms:int>"
)
PLAN = (
    "session_id string, goal string, plan struct<goal:string,chain_of_thought:string,"
    f"total_steps:int,steps:array<{PLAN_STEP}>>"
)
SESSION_TABLE = (
    "session_id string, goal string, plan_id string, step_ids string, "
    "completed_step_ids string, user_preferences string, extracted_entities string, "
    "created_at double, updated_at double, archived int"
)
MEMORY_TABLE = (
    "key string, value string, category string, source_session_id string, "
    "created_at double, updated_at double"
)
ELEMENT_COLUMNS = {
    "session_id": "string", "step_no": "bigint", "element_pos": "int",
    "element_id": "string", "tag": "string", "selector": "string",
    "text": "string", "placeholder": "string", "value": "string", "href": "string",
    "type": "string", "autocomplete": "string", "role": "string",
    "interactive": "boolean", "coordinates": "array<double>",
    "parent_tag": "string", "parent_class": "string", "parent_id": "string",
    "nearby_labels": "string",
}
