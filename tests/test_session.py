from crewgate.session import ensure_checkpoint_dir, scratch_path


def test_checkpoint_folder_comes_from_the_session(spark):
    first = ensure_checkpoint_dir(spark)
    assert first and first == spark.sparkContext.getCheckpointDir()
    # asking again never replaces the folder the session already names
    assert ensure_checkpoint_dir(spark) == first


def test_scratch_paths_are_fresh_and_shared(spark):
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    root = ensure_checkpoint_dir(spark)
    assert a != b and a.startswith(root) and b.startswith(root)
