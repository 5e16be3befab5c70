"""Schemas of the tables, as DDL. Nothing is inferred."""

from __future__ import annotations

CIRCUITS = "name string, qasm string, file string"
OPERATIONS = "array<struct<pos:int,op:string,params:array<string>,qubits:array<int>,clbits:array<int>>>"
DEVICES = "device_id string, num_qubits int, operation_names array<string>, all_to_all boolean, device_pos int"
DEVICE_EDGES = "device_id string, src int, dst int"
DEVICE_INSTRUCTIONS = (
    "device_id string, name string, num_qubits int, qubits array<int>, error double, duration_seconds double")
JOBS = "circuit string, device string, num_qubits int, key string, source string, output string"
MANIFEST = (
    "line_no struct<modified:timestamp,file:string,block:bigint,row:bigint>, timestamp string, key string, circuit string, device string, attempt bigint, status string, mode string, "
    "phase string, pid bigint, duration_seconds double, passes array<string>, fallback_reason string, rl_status string, error string, traceback string")
SCORES = "circuit string, device string, device_pos int, score double"
TRAINING = "circuit string, features map<string,double>, label string"
SELECTOR_RECORD = (
    "struct<index:int,circuit:string,source_qasm:string,label_device:string,scores:map<string,double>,features:map<string,double>,"
    "compiled_circuits:map<string,struct<mode:string,status:string,qasm:string,passes:array<string>,error:string,used_for_score:boolean>>>")
SELECTOR_DATASET = (
    "schema_version int, worst_score double, generated_at string, metric string, source_corpus string, sample_count int, feature_count int, "
    "devices array<string>, label_distribution map<string,int>, compilation_provenance map<string,int>, feature_names array<string>, "
    f"records array<{SELECTOR_RECORD}>")
CONTEXT_RECORD = (
    "struct<record_id:string,input:struct<objective:struct<name:string,direction:string>,user_constraints:map<string,string>,"
    "circuit:struct<name:string,qasm2:string,summary:map<string,string>,features:struct<by_name:map<string,double>>>,"
    "compatible_backends:array<struct<id:string,num_qubits:int,operation_names:array<string>>>>>")
CONTEXT_DATASET = (f"schema_version string, records array<{CONTEXT_RECORD}>")
REQUESTS = (
    "request_id string, user_text string, qasm2 string, circuit_name string, figure_of_merit string, allowed_devices array<string>, constraints string")
MONITOR = "r double, l bigint, t double"
