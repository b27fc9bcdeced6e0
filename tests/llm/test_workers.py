from halyard.llm import workers


def test_a_worker_keeps_the_tables_of_one_operator():
    made = []
    for key in ("a", "a", "b", "a"):
        workers.kept((key,), lambda key=key: made.append(key))
    assert made == ["a", "b", "a"]


def test_only_functions_that_keep_tables_find_them_again():
    workers.kept(("a",), list)
    assert list(workers.tidy(iter, keeps=True)([1, 2])) == [1, 2] and ("a",) in workers._KEPT
    assert list(workers.tidy(iter)([])) == [] and not workers._KEPT
