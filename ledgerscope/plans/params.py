"""Fixed arguments of the registered queries (FIXTURES.md): the reporting
window, the anchor day for presets and age, and the drill-down asset type."""

import datetime as dt

from ledgerscope.functions.periods import Window

START = dt.date(2024, 1, 5)
END = dt.date(2024, 1, 20)
AS_OF = dt.date(2024, 1, 31)
WINDOW = Window(START, END)
PRESET = "Last 30 Days"
#: Days at which the ledger is cut into batches.
BATCH_DAYS = [dt.date(2024, 1, 10), dt.date(2024, 1, 18)]
#: Buckets of the fixture's ledger store.
STORE_BUCKETS = 8
SELECTED_ASSET = "equity"
