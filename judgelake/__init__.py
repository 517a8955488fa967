"""judgelake: DataFrame operators for rubric-graded data and training corpora."""
