"""Account-authenticity analytics over tables and streams, as DataFrame functions."""
