"""Schemas of the step table and of what the engine derives from it."""

from __future__ import annotations

TARGET = "struct<selector:string,bbox:array<double>,coords:array<double>,text:string>"
ACTION = f"struct<action_type:string,target:{TARGET},value:string,confidence:double>"
ELEMENT = "struct<index:int,tag:string,text:string,attributes:map<string,string>,representation:string>"

#: One row is one UI action; every column may be null.  ``step_index`` orders a
#: task's steps explicitly, so nothing depends on the order of rows in files.
STEPS = """
action_uid string, raw_html string, cleaned_html string, operation string,
pos_candidates array<string>, neg_candidates array<string>,
website string, domain string, subdomain string,
annotation_id string, confirmed_task string,
screenshot struct<bytes:binary,path:string>,
action_reprs array<string>, target_action_index string, target_action_reprs string,
step_index int
"""

#: Action types that a prediction may have (fixed values).
ACTION_TYPES = ("click", "type", "scroll", "noop")
#: Words a plan may name as its action (fixed values).
PLAN_TYPES = ("click", "input", "type", "select", "scroll", "finish", "hover")
