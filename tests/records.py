"""Frozen records that several tests start from."""

import json

from ledgerlark.functions import hashing as H
from ledgerlark.operators import validation as V

SYSTEM = "answer in json"
RECORD = "example_id string, molecule_id string, task_family string, task_type string, prompt array<struct<role:string,content:string>>, target_json string, constraints_json string, reference_smiles string, metadata_json string, molecular_complexity double, multitask_load int, question_seed bigint, source_dataset_revision string, generator_revision string, preprocessing_config_hash string"


def record(family="count", **changes):
    source = "CCO"
    base = {
        "example_id": f"e-{family}", "molecule_id": H.text_sha256(source)[:24], "task_family": family, "task_type": V.TASK_TYPES[family][0],
        "prompt": [("system", SYSTEM), ("user", "how many?")], "target_json": '{"ring_count":2}', "constraints_json": "[]", "reference_smiles": "",
        "metadata_json": json.dumps({"task_type": V.TASK_TYPES[family][0], "smiles": source, "properties": ["ring"], "key_names": ["ring_count"]}),
        "molecular_complexity": 6.0, "multitask_load": 1, "question_seed": 123, "source_dataset_revision": "r1", "generator_revision": "g1", "preprocessing_config_hash": "h",
    }
    if family == "index":
        base |= {"target_json": '{"ring_count":[0,2]}'}
    if family == "constraint":
        constraints = [{"type": "ring", "operator": "=", "value": 1}]
        base |= {
            "target_json": "{}", "constraints_json": H.canonical_json(constraints), "reference_smiles": source,
            "metadata_json": json.dumps({"task_type": "constraint_generation", "constraints": constraints}),
        }
    return base | changes
