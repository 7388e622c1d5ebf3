"""The same operators on streams: sessions, rates, scoring of closed sessions, live blocks."""
