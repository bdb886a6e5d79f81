"""Fabricated values."""


def luhn_digit(x: str) -> str:
    total = 0
    for i, c in enumerate(reversed(x)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def luhn_ok(x: str) -> bool:
    return luhn_digit(x[:-1]) == x[-1]


def national_id(nine: str) -> str:
    return nine + luhn_digit(nine)


def iban(bban: str, country: str = "SA") -> str:
    number = "".join(str(int(c, 36)) for c in bban + country + "00")
    return f"{country}{98 - int(number) % 97:02d}{bban}"
