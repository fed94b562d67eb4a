"""Value-flow analytics over transaction ledgers, as DataFrame -> DataFrame functions."""
