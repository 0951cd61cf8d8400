import random
import re

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def upper(text):
    return re.sub("[a-z]+", lambda m: m[0].upper(), text)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioulmnrstéß") for _ in range(rng.randint(2, 9))) for _ in range(n))
