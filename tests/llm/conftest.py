import pytest


@pytest.fixture
def bank_schema():
    return (
        "record_id bigint, question_id string, split_role string, data_source string, question string, node string, key string, "
        "candidates array<struct<candidate_id:string,model_name:string,response:string,reward_result:struct<raw_judge_responses:array<string>>>>"
    )
