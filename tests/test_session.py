import os
import subprocess
import sys
import textwrap

from tracelight import session


def fresh(code, folder, *paths):
    """Runs code in an interpreter that knows neither the repository nor PYTHONPATH."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = f"import sys; sys.path[:0] = {list(paths)!r}\n" + textwrap.dedent(code)
    return subprocess.run([sys.executable, "-c", script], cwd=folder, env=env, capture_output=True, text=True, timeout=200)


def test_the_archive_is_a_whole_package(tmp_path):
    archive = session.package_archive(str(tmp_path))
    code = """
        import tracelight.plans.catalog as catalog
        print(catalog.__file__, len(catalog.load()))
    """
    out = fresh(code, tmp_path, archive)
    assert out.returncode == 0, out.stderr[-2000:]
    place, count = out.stdout.split()
    assert place.startswith(archive) and int(count) > 150
    assert fresh(code, tmp_path).returncode != 0  # the archive alone made it work


def test_tasks_can_import_the_shipped_package(spark, tmp_path):
    """Executors get the archive with the application, and the driver's folders play no part in its import."""
    session.ship(spark)

    def look(_):
        import zipfile

        from pyspark import SparkFiles

        path = os.path.join(SparkFiles.getRootDirectory(), "tracelight.zip")
        return [(path in sys.path, "tracelight/session.py" in zipfile.ZipFile(path).namelist())]

    assert set(spark.sparkContext.parallelize(range(4), 4).mapPartitions(look).collect()) == {(True, True)}
