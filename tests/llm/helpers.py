import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, n int, size int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def sample(n, seed, vocabulary=300):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def frame(spark, rows):
    """Documents with extra columns whose names operators also use."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 0.5, 1, 2, 3) for i, t in rows], SCHEMA)
