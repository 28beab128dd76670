"""Declared schemas of the records that readers, validators and converters share."""

from __future__ import annotations

from pyspark.sql import types as T

IMAGE = "struct<path:string,role:string,width:int,height:int,transform:string>"
SAMPLE = f"id string, dataset string, subtask string, task_type string, prompt string, images array<{IMAGE}>, references array<string>, choices map<string,string>, answer_labels array<string>, accepted_labels array<string>, clean_status string, issues array<string>, metadata string, split string, source string, schema_version string"
PREDICTION = SAMPLE + ", prediction string, error string, generation_truncated boolean, attempt int, max_new_tokens int, elapsed_seconds double"
MESSAGES = "messages array<struct<role:string,content:array<struct<type:string,image:string,text:string>>>>, references array<string>"
CONVERSATIONS = "id string, image array<string>, conversations array<struct<`from`:string,value:string>>, loss_weight double"
MCQ = "image_path string, question string, options array<string>, answer string"
COCO = "images array<struct<id:int,file_name:string,width:int,height:int>>, annotations array<struct<id:int,image_id:int,category_id:int,bbox:array<double>,area:double,iscrowd:int>>, categories array<struct<id:int,name:string>>"
DETECTION = "detection_id string, image string, cls string, score double, box array<double>, width int, height int, mask_path string, source string"
VECTORS = "group_id bigint, token_id int, embedding array<float>"
ATTEMPT_INSTANCE = "struct<prediction_index:int,score:double,retained:boolean,valid_mask:boolean,box:array<double>>"
TRAJECTORY = f"sample_id string, question string, gt_answer string, answer_correct boolean, num_pop double, accepted boolean, target_traces array<struct<target_index:int,target_text:string,attempts:array<struct<call_index:int,stage:string,success:boolean,instances:array<{ATTEMPT_INSTANCE}>>>>>"
RL_RECORD = "data_source string, prompt array<struct<role:string,content:string>>, images array<struct<image:string>>, ability string, reward_model struct<style:string,ground_truth:string>, extra_info struct<id:string,index:bigint,split:string>"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
