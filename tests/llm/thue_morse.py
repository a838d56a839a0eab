def thue_morse(levels: int, a: str = "a", b: str = "b") -> tuple[str, str]:
    """Two different strings of 2**levels symbols whose polynomial hashes modulo 2**64 agree from 11 levels on, whatever the base."""
    x, y = a, b
    for _ in range(levels):
        x, y = x + y, y + x
    return x, y
