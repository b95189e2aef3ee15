"""Record schemas.  Positions are strings because producers write both ``3`` and ``"3"``."""

from __future__ import annotations

ARGUMENT = ("struct<text:string,span:string,start:string,end:string,entity_id:string,"
            "role:string,role_type:string,label:string>")
EVENT = f"struct<id:string,event_type:string,trigger:struct<start:string,end:string>,arguments:array<{ARGUMENT}>>"
ENTITY = "struct<id:string,entity_id:string,start:string,end:string>"

CORPUS = f"tokens array<string>, event_mentions array<{EVENT}>, entity_mentions array<{ENTITY}>"

DOCUMENT = "doc_id string, text string"

PREDICTION = ("epoch int, dataset string, doc_id string, split string, task string, "
              "index bigint, source string, reference string, prediction string")

_SINGLE = "struct<input:string,reference:string,prediction:string>"
_LISTS = "struct<inputs:array<string>,references:array<string>,predictions:array<string>>"
RESULT_ITEM = (
    "doc_id string, source string, "
    f"trigger_identification {_SINGLE}, trigger_classification_pipeline {_SINGLE}, "
    f"trigger_classification_e2e {_SINGLE}, event_extraction_e2e {_SINGLE}, "
    f"argument_extraction_pipeline_pipeline {_LISTS}, argument_extraction_pipeline_e2e {_LISTS}, "
    f"argument_extraction_pipeline_merged {_LISTS}"
)

OUT_ARGUMENT = "struct<text:string,role:string,offset:array<int>>"
OUT_EVENT = f"struct<trigger:struct<text:string,type:string,offset:array<int>>,arguments:array<{OUT_ARGUMENT}>>"
MODE_RESULT = f"struct<doc_id:string,source:string,events:array<{OUT_EVENT}>>"
ANNOTATED = (
    "doc_id string, source string, "
    f"events map<string,struct<pipeline:{MODE_RESULT},e2e:{MODE_RESULT},merged:{MODE_RESULT}>>, "
    f"complete_e2e map<string,{MODE_RESULT}>"
)

DECISION = ("fp_id string, dataset string, model_name string, doc_id string, decision string, notes string, "
            "schema_checked boolean, reviewer string, timestamp timestamp")

# Task, split, mode and decision names.
SPLIT_FILES = {"train": "train.json", "val": "dev.json", "test": "test.json"}
TASKS = (
    "trigger_identification",
    "trigger_classification_pipeline",
    "trigger_classification_e2e",
    "argument_identification_e2e",
    "argument_extraction_pipeline",
    "event_extraction_e2e",
    "trigger_identification_augument",
)
MODES = ("pipeline", "e2e", "merged")
DECISIONS = ("true_positive_missing_gold", "true_false_positive", "uncertain")
