"""Life of a session on the driver: which step may follow which."""

from __future__ import annotations

from dataclasses import dataclass, field

CREATED, STARTED, DEVICES_REGISTERED = "created", "started", "devices_registered"
#: Steps that follow once registration is over are done by the engine, not by the manager.
DEFERRED = ("synchronized", "validated", "emitted")
_NEXT = {CREATED: (STARTED,), STARTED: (DEVICES_REGISTERED,), DEVICES_REGISTERED: DEFERRED}


class TransitionError(ValueError):
    """A step that may not follow the present one."""


@dataclass
class SessionManager:
    session_id: str
    state: str = CREATED
    devices: dict[str, bool] = field(default_factory=dict)
    calibrations: list[str] = field(default_factory=list)
    ground_truth: dict = field(default_factory=dict)

    def advance(self, state: str) -> SessionManager:
        if state not in _NEXT.get(self.state, ()):
            raise TransitionError(f"{self.state} -> {state}")
        if state in DEFERRED:
            raise NotImplementedError(f"{state} is reached by plans.engine.synchronize")
        self.state = state
        return self

    def start(self) -> SessionManager:
        return self.advance(STARTED)

    def _open(self) -> None:
        if self.state != STARTED:
            raise TransitionError(f"not while {self.state}")

    def register_device(self, device_id: str, reference: bool = False) -> SessionManager:
        self._open()
        if not device_id or device_id in self.devices:
            raise ValueError(f"device ids are unique and not empty: {device_id!r}")
        self.devices[device_id] = reference
        return self

    def attach_calibration(self, ref: str) -> SessionManager:
        self._open()
        self.calibrations.append(ref)
        return self

    def attach_ground_truth(self, device_id: str, alpha: float, beta_us: float) -> SessionManager:
        self._open()
        if device_id not in self.devices:
            raise ValueError(f"unknown device {device_id!r}")
        self.ground_truth[device_id] = (alpha, beta_us)
        return self

    def finalize_registration(self) -> SessionManager:
        """Exactly one device must be the reference."""
        if self.state == STARTED and sum(self.devices.values()) != 1:
            raise ValueError("a session has exactly one reference device")
        return self.advance(DEVICES_REGISTERED)
