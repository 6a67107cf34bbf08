import os

from helixframe.storage import scratch, stored


def test_scopes_delete_what_was_stored_in_them(spark):
    gone = lambda df: not os.path.exists(df.stored_at.removeprefix("file://"))
    with scratch(spark):
        a = stored(spark.range(3), "a")
        with scratch(spark):
            b, c = stored(a, "b"), stored(a, "c", outlives=True)
        assert gone(b) and not gone(a) and c.count() == 3
    assert gone(a) and gone(c)
    d = stored(spark.range(1), "d")
    with scratch(spark):
        e = stored(d, "e", outlives=True)
    assert not gone(d) and e.count() == 1


def test_threads_have_their_own_scopes(spark):
    import os
    import threading

    kept = []

    def other():
        kept.append(stored(spark.range(3), "thread").stored_at)

    with scratch(spark):
        thread = threading.Thread(target=other)
        thread.start()
        thread.join()
        own = stored(spark.range(2), "own").stored_at
    assert os.path.isdir(kept[0].removeprefix("file://")) and not os.path.isdir(own.removeprefix("file://"))
